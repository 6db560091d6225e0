"""HTML extraction: what a page shows, laid out as plain text.

A forgiving tree builder supplies the tags that pages leave out; a page's own rules decide what is
visible; the rest is laid out as blocks and lines. Nothing that is visible is dropped as boilerplate:

    blocks     begin on a new line; those with margins are set off by an empty line; margins collapse
    lists      `- ` or numbers, items below one another, inner lists indented
    tables     rows are lines, cells are padded to their column, spans are respected
    pre        keeps its white space; elsewhere white space collapses

Invisible are head, scripts, styles, templates and the like, the `hidden` attribute, closed details and
dialogs, and what inline style or the page's own style sheets set to `display: none` or `visibility: hidden`.
What is not displayed takes all below with it; visibility is inherited and may be undone below. Selectors are tags,
.classes, #ids and [attributes], together and below one another (`a b`, `a > b`); those that ask for siblings or a
state (`:hover`) are passed over. Where rules disagree on an element, importance, layer, the selector's weight and
order decide. Of rules inside at-rules only those of `@layer` and of `@media` for screen or all, without conditions,
count. Scripts do not run, so `noscript` shows.

Each page is one row's work, in memory proportional to it. Elements are opened at every depth, so what
hides them does too; only indentation and padding end somewhere. Defined results: a null or empty page
is the empty text; broken markup is repaired, never an error (a declaration, comment or instruction that
is left open ends with the page); repeated rows and null ids are rows like any other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator
from html.parser import HTMLParser
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batches, ship, table

#: Lists, quotes and definitions are indented up to so many levels; what lies deeper is no less shown.
INDENTED = 40
#: Columns are padded to their widest cell, but no further than this.
WIDEST_COLUMN = 60
#: Where a column begins at most; cells beyond stand side by side.
WIDEST_TABLE = 2000
#: Spans that a cell may ask for (fixed values of the HTML standard).
COLSPAN, ROWSPAN = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("head script style template noframes iframe object audio video canvas datalist title".split())
#: Of drawings and formulas, what is not drawn.
UNDRAWN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern marker".split()), "math": frozenset(("annotation", "annotation-xml"))}
#: Blocks with a margin above and below, and without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset article section".split())
BLOCKS = SPACED | frozenset("html body div li dt dd address aside main nav header footer form details summary figcaption legend caption dialog center hgroup search tr thead tbody tfoot td th optgroup".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
CELLS = frozenset(("td", "th"))
#: A start tag closes open elements of these kinds, up to the nearest element that bounds them.
CLOSES = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "td": (CELLS | {"caption", "colgroup"}, frozenset(("tr", "table"))),
    "th": (CELLS | {"caption", "colgroup"}, frozenset(("tr", "table"))),
    **{x: (CELLS | SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))) for x in (*SECTIONS, "caption", "colgroup")},
}
#: The elements of a table that a part of it stands in, or below.
TABLE_PARTS = {
    **dict.fromkeys(CELLS, SECTIONS | {"tr", "table"}),
    "tr": SECTIONS | {"table"},
    **dict.fromkeys((*SECTIONS, "caption", "colgroup"), frozenset(("table",))),
}
#: Block starts close an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend", "optgroup"}
#: An end tag does not reach past these, unless it is theirs.
BOUNDS = frozenset(("table", "td", "th", "caption", "button", "html", "template"))


class Element:
    __slots__ = ("tag", "attrs", "children", "names", "shown", "seen")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.names: frozenset[str] = frozenset()  # what selectors call it; with the next two set by `styled`
        self.shown = self.seen = True


class TreeBuilder(HTMLParser):
    """The tree of a page; missing html, body, table sections and rows are supplied."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}  # where in `open` the elements of each tag stand
        self.styles: list[str] = []
        self.drawn = False  # whether the page has svg or math

    def _push(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        e = Element(tag, attrs or {})
        self.open[-1].children.append(e)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(e)

    def _cut(self, size: int) -> None:
        """Leaves the first `size` elements open."""
        while len(self.open) > size:
            self.places[self.open.pop().tag].pop()

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0, the root's, if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, kinds: frozenset[str], bounds: frozenset[str]) -> None:
        """Closes the elements of these kinds that are open inside the innermost bound."""
        at = [self.places[t] for t in kinds if self.places.get(t)]
        if at:
            bound = self._last(bounds)
            found = [x[k] for x in at if (k := bisect_right(x, bound)) < len(x)]
            if found:
                self._cut(min(found))

    def _ready(self, tag: str) -> None:
        """Closes and opens what must be before `tag` starts."""
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ENDS_PARAGRAPH:
            self._close(frozenset(("p",)), BOUNDS | {"button"})
        if tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
            self._cut(len(self.open) - 1)
        if self.places.get("table"):
            if tag in TABLE_PARTS:  # what does not belong into a table ends where a part of it starts
                self._cut(self._last(TABLE_PARTS[tag]) + 1)
            if tag in CELLS and self.open[-1].tag != "tr":
                self._ready("tr")
                self._push("tr")
            elif tag == "tr" and self.open[-1].tag == "table":
                self._push("tbody")
        if self.places.get("head") and tag not in INVISIBLE | {"meta", "link", "base", "noscript"}:
            self._close(frozenset(("head",)), frozenset())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            self._ready(tag)
            self.root.attrs.update({k: v or "" for k, v in attrs if k in ("hidden", "style")})
            return
        self._ready(tag)
        found = {k: v or "" for k, v in attrs}
        self.drawn = self.drawn or tag in UNDRAWN
        for outer in [x for x in UNDRAWN if self.places.get(x)] if self.drawn else ():
            if tag in UNDRAWN[outer]:
                found["hidden"] = ""
            elif (outer, tag) == ("svg", "text"):
                found["_apart"] = ""
        if tag in VOID:
            self.open[-1].children.append(Element(tag, found))
        else:
            self._push(tag, found)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements, which are closed anyway, and those of svg and math
        if self.drawn and self.open[-1].tag == tag and any(self.places.get(x) for x in UNDRAWN):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Element("br", {}))
            return
        at = self.places.get(tag)
        if not at or at[-1] == 0:
            return
        free = tag in BOUNDS or tag in SECTIONS or tag == "tr"
        if free or self._last(BOUNDS) <= at[-1]:
            self._cut(at[-1])

    def _to(self, i: int, end: str) -> int:
        """The place after the next `end`, or the page's end: the whole page is read at once."""
        k = self.rawdata.find(end, i)
        return len(self.rawdata) if k < 0 else k + len(end)

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = re.compile(r"--!?\s*>|(?<=<!-)->|(?<=<!--)>").search(self.rawdata, i + 3)
        return found.end() if found else len(self.rawdata)

    def parse_bogus_comment(self, i: int, report: bool = True) -> int:
        return self._to(i + 2, ">")

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![CDATA[", i) and any(self.places.get(x) for x in UNDRAWN):
            end = self._to(i + 9, "]]>")
            self.handle_data(self.rawdata[i + 9 : end].removesuffix("]]>"))
            return end
        return self._to(i + 2, ">")

    def parse_pi(self, i: int) -> int:
        return self._to(i + 2, ">")

    def close(self) -> None:
        if self.cdata_elem == "style":  # left open, it ends with the page
            self.handle_data(self.rawdata)
        super().close()

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            if applies("@media " + self.open[-1].attrs.get("media", "")):
                self.styles.append(data)
        elif data.strip() and self.open[-1].tag == "head":
            self._close(frozenset(("head",)), frozenset())
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    """The page's tree, in which every element knows whether it shows."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    styled(builder.root, Sheet(" ".join(builder.styles)))
    return builder.root


#: A decision on whether an element shows: its precedence, and whether it hides; None inherits.
Decision = tuple[tuple, "bool | None"]
PROPERTIES = ("display", "visibility")


class Compound(NamedTuple):
    """What a selector asks of one element: names (a tag, .classes, an #id) and (attribute, relation, value)."""

    names: frozenset[str]
    attributes: tuple[tuple[str, str, str], ...] = ()

    def fits(self, e: Element) -> bool:
        return self.names <= e.names and all(_related(e.attrs.get(name), how, value) for name, how, value in self.attributes)

    def key(self) -> str:
        """The name by which it is found: an id or a class rather than a tag; * where it has none."""
        return max(self.names, key=lambda x: (".#".find(x[0]), x), default="*")


def _related(found: str | None, how: str, value: str) -> bool:
    if found is None or how == "":
        return found is not None
    return {"=": found == value, "~=": value in found.split(), "|=": found == value or found.startswith(value + "-"), "^=": bool(value) and found.startswith(value), "$=": bool(value) and found.endswith(value), "*=": bool(value) and value in found}[how]


class Rule(NamedTuple):
    """A selector, from the element up: compounds, and whether each next one is the parent itself; and what it decides by property."""

    compounds: tuple[Compound, ...]
    child: tuple[bool, ...]
    decisions: dict[str, Decision]


_PART = re.compile(r"""([.#]?(?:[\w-]|[^\x00-\x7f])+|\*)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]"']+))\s*)?\]""")


def selected(selector: str) -> tuple[tuple[Compound, ...], tuple[bool, ...], tuple[int, int, int]] | None:
    """A selector's compounds from the element up, where the next one up is its parent, and its weight. None for what no page shows by itself (states, siblings)."""
    compounds, child, weight = [], [], [0, 0, 0]
    tokens = re.findall(r"""\s*>\s*|\s+|(?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|[^\s>\[])+""", selector.strip())
    if len(tokens) % 2 == 0:
        return None
    for k, token in enumerate(tokens):
        if k % 2:
            child.append(">" in token)
            continue
        names, attributes, at = set(), [], 0
        while at < len(token):
            m = _PART.match(token, at)
            if not m or (m[1] and m[1][0] not in ".#" and at):  # also :hover, ::before, + and ~
                return None
            if m[2]:
                attributes.append((m[2].lower(), m[3] or "", next((x for x in m.group(4, 5, 6) if x is not None), "")))
                weight[1] += 1
            elif m[1] != "*":
                names.add(m[1].lower())
                weight["#.".find(m[1][0]) if m[1][0] in "#." else 2] += 1
            at = m.end()
        compounds.append(Compound(frozenset(names), tuple(attributes)))
    return tuple(reversed(compounds)), tuple(reversed(child)), tuple(weight)


class Sheet:
    """A page's own rules on what shows, and, as the page is walked through, where the elements are open that they ask for above an element."""

    def __init__(self, text: str):
        self.by_key: dict[str, list[Rule]] = {}
        self.above: dict[str, list[Compound]] = {}
        self.open: dict[Compound, list[int]] = {}
        for order, (selectors, body, layered) in enumerate(rules(re.sub(r"/\*.*?\*/", "", text, flags=re.DOTALL))):
            found = declared(body)
            for one in selectors.split(",") if found else ():
                if parts := selected(one):
                    compounds, child, weight = parts
                    self.by_key.setdefault(compounds[0].key(), []).append(Rule(compounds, child, {name: ((important, layered == important, weight, order), hide) for name, (important, hide) in found.items()}))
                    for c in compounds[1:]:
                        if c not in self.open:
                            self.open[c] = []
                            self.above.setdefault(c.key(), []).append(c)

    def enter(self, e: Element, depth: int) -> list[Compound]:
        """Notes that an element is open; what it returns is to be closed with `leave`."""
        if not self.above:
            return []
        fit = [c for name in (*e.names, "*") for c in self.above.get(name, ()) if c.fits(e)]
        for c in fit:
            self.open[c].append(depth)
        return fit

    def leave(self, fit: list[Compound]) -> None:
        for c in fit:
            self.open[c].pop()

    def decide(self, e: Element, depth: int) -> dict[str, Decision]:
        """The decision that wins, by property."""
        best: dict[str, Decision] = {}
        for name in (*e.names, "*"):
            for rule in self.by_key.get(name, ()):
                if rule.compounds[0].fits(e) and self._stands(rule, 1, depth - 1):
                    for prop, decision in rule.decisions.items():
                        if prop not in best or decision[0] > best[prop][0]:
                            best[prop] = decision
        return best

    def _stands(self, rule: Rule, k: int, depth: int) -> bool:
        """Whether the compounds from the k-th on are open at this depth and above."""
        if k == len(rule.compounds):
            return True
        places = self.open[rule.compounds[k]]
        at = bisect_right(places, depth) - 1
        if rule.child[k - 1]:
            return at >= 0 and places[at] == depth and self._stands(rule, k + 1, depth - 1)
        if True not in rule.child[k:]:  # the nearest is as good as any
            return at >= 0 and self._stands(rule, k + 1, places[at] - 1)
        return any(self._stands(rule, k + 1, places[i] - 1) for i in range(at, -1, -1))


def styled(root: Element, sheet: Sheet) -> None:
    """Sets `shown` (displayed at all) and `seen` (its own text is visible) of every element below what is not shown.

    What is not displayed takes all below with it. Visibility is inherited, and may be undone below.
    """
    waiting: list[tuple[Element | None, Any]] = [(root, True)]
    depth = 0
    while waiting:
        e, state = waiting.pop()
        if e is None:
            sheet.leave(state)
            depth -= 1
            continue
        a = e.attrs
        e.names = frozenset((e.tag, *("." + c.lower() for c in a.get("class", "").split()), *(["#" + a["id"].lower()] if a.get("id") else [])))
        best = sheet.decide(e, depth) if sheet.by_key else {}
        for name, (important, hide) in (declared(a["style"]) if "style" in a else {}).items():
            if name not in best or important >= best[name][0][0]:
                best[name] = (important,), hide
        hidden = best["display"][1] if "display" in best else "hidden" in a
        e.shown = not (e.tag in INVISIBLE or hidden or (e.tag == "dialog" and "open" not in a))
        if e.shown:
            own = best["visibility"][1] if "visibility" in best else None
            e.seen = state if own is None else not own
            waiting.append((None, sheet.enter(e, depth)))
            depth += 1
            waiting += [(c, e.seen) for c in reversed(e.children) if not isinstance(c, str)]


def rules(sheet: str) -> Iterator[tuple[str, str, bool]]:
    """(selectors, declarations, whether in a layer) of the rules that hold on every screen; blocks left open end with the sheet."""
    blocks: list[tuple[str, bool, bool]] = []  # of each open block: head, whether it holds, whether layered
    parts: list[str] = []
    body = ""
    tokens = re.findall(r"""(?:[^{};"'\\]++|\\.|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')++|.""", sheet, re.DOTALL)
    for token in [*tokens, *"}" * sheet.count("{")]:
        if token == "{":
            head = "".join(parts).strip()
            above, holds, layered = blocks[-1] if blocks else ("@", True, False)
            holds = holds and above[:1] == "@" and (head[:1] != "@" or applies(head))
            blocks.append((head, holds, layered or head[:6].lower() == "@layer"))
            parts = []
            body = "" if holds else body
        elif token == "}":
            if blocks:
                head, holds, layered = blocks.pop()
                if holds and head[:1] != "@":
                    yield head, body + "".join(parts), layered
            parts = []
        elif token == ";":
            if blocks and blocks[-1][1] and blocks[-1][0][:1] != "@":
                body += "".join(parts) + ";"
            parts = []
        else:
            parts.append(token)


def applies(head: str) -> bool:
    """Whether an at-rule's block holds on every screen."""
    if re.match(r"@layer\b", head, re.IGNORECASE):
        return True
    media = re.fullmatch(r"@media\b(.*)", head, re.IGNORECASE | re.DOTALL)
    return bool(media) and any(re.fullmatch(r"(?:(?:only\s+)?(?:screen|all))?", x.strip(), re.IGNORECASE) for x in media[1].split(","))


def declared(style: str) -> dict[str, tuple[bool, bool | None]]:
    """(important, hides) of each of PROPERTIES that the declarations set; the last counts, after important ones."""
    found: dict[str, tuple[bool, bool]] = {}
    for name, value, rest in re.findall(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)([^;]*)", style, re.IGNORECASE):
        name, important = name.lower(), bool(re.search(r"!\s*important\b", rest, re.IGNORECASE))
        if important or not found.get(name, (False,))[0]:
            word = value.lower()
            found[name] = important, word == "none" if name == "display" else None if word in ("inherit", "unset") else word in ("hidden", "collapse")
    return found


class Layout:
    """Lines of a block; `gap` empty lines are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False  # white space is due before the next word

    def text(self, data: str, keep: bool) -> None:
        if keep:
            parts = data.expandtabs(8).split("\n")
            for k, part in enumerate(parts):
                if k:
                    self.newline()
                if part:
                    self._due()
                    self.line.append(part)
            return
        words = data.split(" ") if data.isalnum() else re.split(r"[ \t\n\r\f]+", data)
        for k, w in enumerate(words):
            if k:
                self.space = bool(self.line)
            if w:
                self._due()
                if self.space:
                    self.line.append(" ")
                    self.space = False
                self.line.append(w)

    def _due(self) -> None:
        if self.gap:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0

    def newline(self) -> None:
        """Ends the line, empty or not."""
        self._due()
        self.lines.append("".join(self.line))
        self.line, self.space = [], False

    def block(self, margin: int) -> None:
        if self.line:
            self.newline()
        self.space = False
        self.gap = max(self.gap, margin)

    def add(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        if lines:
            self._due()
            self.lines.extend(lines)

    def done(self) -> list[str]:
        self.block(0)
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return [x.rstrip() for x in self.lines]


#: A step of rendering: it yields steps that it waits for, is sent their results, and returns its own.
Step = Generator[Any, Any, Any]


def carried_out(step: Step) -> Any:
    """What a step returns. Steps wait on a list, not on Python's own stack, so pages may be of any depth."""
    waiting, value = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


class Renderer:
    def __init__(self) -> None:
        self.level = 0  # of indentation

    def visible(self, e: Element) -> bool:
        return e.shown

    def render(self, e: Element) -> Step:
        """The lines of an element."""
        out = Layout()
        if self.visible(e):
            yield self._into(e, out, e.tag == "pre")
        return out.done()

    def _indented(self, e: Element, mark: str) -> Step:
        """The lines of an element, the first after a mark and the others below it."""
        deep = self.level >= INDENTED
        self.level += 1
        lines = yield self.render(e)
        self.level -= 1
        below = "" if deep else " " * len(mark)
        return [(mark if not k else below) + x if x else x for k, x in enumerate(lines)]

    def _into(self, e: Element, out: Layout, keep: bool) -> Step:
        shut = e.tag == "details" and "open" not in e.attrs
        for c in e.children:
            if isinstance(c, str):
                if not shut and e.seen:
                    out.text(c, keep)
            elif self.visible(c) and not (shut and c.tag != "summary"):
                yield self._element(c, out, keep)

    def _element(self, e: Element, out: Layout, keep: bool) -> Step:
        tag = e.tag
        if tag == "br":
            out.newline()
        elif tag == "input":
            if e.seen and e.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") and e.attrs.get("value"):
                out.text(f" {e.attrs['value']} ", False)
        elif tag == "select":
            options = self._options(e)
            for o in [o for o in options if "selected" in o.attrs] or options[:1]:
                out.text(" ", False)
                yield self._into(o, out, False)
                out.text(" ", False)
        elif "_apart" in e.attrs:
            out.text(" ", False)
            yield self._into(e, out, False)
            out.text(" ", False)
        elif tag in LISTS:
            margin = 0 if "_inner" in e.attrs else 1
            out.block(margin)
            out.add((yield self._list(e)))
            out.block(margin)
        elif tag == "table":
            out.block(1)
            out.add((yield self._table(e)))
            out.block(1)
        elif tag in ("blockquote", "dd"):
            out.block(int(tag in SPACED))
            out.add((yield self._indented(e, "  " if self.level < INDENTED else "")))
            out.block(int(tag in SPACED))
        elif tag in BLOCKS:
            out.block(int(tag in SPACED))
            yield self._into(e, out, keep or tag == "pre")
            out.block(int(tag in SPACED))
        else:
            yield self._into(e, out, keep)

    def _options(self, e: Element) -> list[Element]:
        """The visible options below a select, in order."""
        found, waiting = [], [e]
        while waiting:
            x = waiting.pop()
            if x.tag == "option":
                found.append(x)
            else:
                waiting += [c for c in reversed(x.children) if isinstance(c, Element) and self.visible(c)]
        return found

    def _list(self, e: Element) -> Step:
        lines: list[str] = []
        number, step = _number(e.attrs.get("start"), 1), -1 if "reversed" in e.attrs else 1
        for c in e.children:
            if isinstance(c, str):
                if c.strip() and e.seen:
                    lines.append(" ".join(c.split()))
                continue
            if not self.visible(c):
                continue
            for inner in c.children:
                if isinstance(inner, Element) and inner.tag in LISTS:
                    inner.attrs["_inner"] = "1"
            if c.tag != "li":  # a list within a list, or what should not be there
                if c.tag in LISTS:
                    c.attrs["_inner"] = "1"
                    deep = self.level >= INDENTED
                    self.level += 1
                    own = yield self._list(c)
                    self.level -= 1
                    lines += own if deep else ["  " + x for x in own]
                else:
                    lines += yield self.render(c)
                continue
            number = _number(c.attrs.get("value"), number)
            mark = f"{counted(number, e.attrs.get('type', '1'))}. " if e.tag == "ol" else "- "
            number += step
            own = yield self._indented(c, mark if c.seen else " " * len(mark))
            lines += own if c.seen or any(x.strip() for x in own) else []
        return lines

    def _table(self, e: Element) -> Step:
        before: list[str] = []
        rows: list[Element] = []
        parts = [c for c in e.children if isinstance(c, Element) and self.visible(c)]
        for kind in ("thead", "tbody", "tfoot"):
            for c in parts:
                if c.tag == kind or (kind == "tbody" and c.tag == "tr"):
                    rows += [c] if c.tag == "tr" else [r for r in c.children if isinstance(r, Element) and r.tag == "tr" and self.visible(r)]
        for c in e.children:  # captions, and what does not belong into a table, come before it
            if isinstance(c, str):
                before += [" ".join(c.split())] if c.strip() and e.seen else []
            elif c.tag not in SECTIONS and c.tag != "tr" and self.visible(c):
                before += yield self.render(c)
            elif c.tag != "tr" and self.visible(c):
                for x in c.children:
                    if isinstance(x, str):
                        before += [" ".join(x.split())] if x.strip() and c.seen else []
                    elif x.tag != "tr" and self.visible(x):
                        before += yield self.render(x)
        grid: list[list[tuple[int, int, list[str]]]] = []
        spanning: list[tuple[int, int, int]] = []  # of cells that reach down: first column, column after, row after
        for y, r in enumerate(rows):
            spanning = sorted(s for s in spanning if s[2] > y)
            x, k, cells, down = 0, 0, [], []
            for c in r.children:
                if isinstance(c, str):
                    if c.strip() and r.seen:
                        before.append(" ".join(c.split()))
                    continue
                if not self.visible(c):
                    continue
                if c.tag not in CELLS:
                    before += yield self.render(c)
                    continue
                while k < len(spanning) and spanning[k][0] <= x:
                    x = max(x, spanning[k][1])
                    k += 1
                wide = min(max(1, _number(c.attrs.get("colspan"), 1)), COLSPAN)
                tall = min(max(1, _number(c.attrs.get("rowspan"), 1)), ROWSPAN)
                if tall > 1:
                    down.append((x, x + wide, y + tall))
                cells.append((x, wide, (yield self.render(c))))
                x += wide
            spanning += down
            grid.append(cells)
        width: dict[int, int] = {}
        for cells in grid:
            for x, wide, text in cells:
                own = max(map(columns, text), default=0) if wide == 1 else 0
                width[x] = max(width.get(x, 0), min(WIDEST_COLUMN, own))
        begins, at = {}, 0
        for x in sorted(width):
            begins[x] = min(at, WIDEST_TABLE)
            at += width[x] + 2 if width[x] else 0
        lines = before
        for cells in grid:
            for k in range(max((len(text) for _, _, text in cells), default=0)):
                line, end = [], 0
                for x, _, text in cells:
                    if k < len(text) and text[k]:
                        gap = max(begins[x] - end, 2 if line else 0)
                        line += [" " * gap, text[k]]
                        end += gap + columns(text[k])
                lines.append("".join(line))
        return lines


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text.strip()) else default


def counted(n: int, kind: str) -> str:
    """A list item's number as the list's type writes it: 1, a, A, i or I; others, and numbers that letters cannot write, in digits."""
    if kind in ("a", "A") and n > 0:
        letters = ""
        while n:
            n, k = divmod(n - 1, 26)
            letters = chr(ord(kind) + k) + letters
        return letters
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


def columns(text: str) -> int:
    """Columns that a text takes: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(carried_out(Renderer().render(parse(html))))


def title_of(html: str | None) -> str | None:
    found = re.search(r"<title[^>]*>(.*?)</title", html or "", re.IGNORECASE | re.DOTALL)
    return " ".join(found[1].split()) if found else None


_TEXTS = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("text", pa.string())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title and visible text of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for page_id, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield page_id, title_of(html), visible_text(html)

        yield from record_batches(rows(), _TEXTS, 512)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, title string, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"), (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"))
