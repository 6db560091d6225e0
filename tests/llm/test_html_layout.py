"""Layouts by hand, and the visible words of generated pages."""

from __future__ import annotations

import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import html_layout as H

CASES = {
    "paragraphs and implied ends": ("<p>a<p>b <b>c</b>\n  d", "a\n\nb c d"),
    "blocks without margins": ("<div>a</div><div>b<div>c</div></div>d", "a\nb\nc\nd"),
    "margins collapse": ("<h1>t</h1><div><p>a</p></div><p>b", "t\n\na\n\nb"),
    "breaks": ("a<br>b<br><br>c</br>d", "a\nb\n\nc\nd"),
    "lists": ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol><li>z</ul>t", "- x\n- y\n  3. q\n  4. r\n- z\n\nt"),
    "item with lines": ("<ol><li>a<br>b<li value=9>c</ol>", "1. a\n   b\n9. c"),
    "table": ("<table><tr><th>Name<th>Age<tr><td>Al<td>3<tr><td>Bo", "Name  Age\nAl    3\nBo"),
    "table spans": ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell<td>d</table>", "a  b\n   c\nwide cell  d"),
    "foot and caption": ("<table><caption>C</caption><tfoot><tr><td>f</tfoot><tr><td>b</table>", "C\nb\nf"),
    "table in a cell": ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i  j  k"),
    "wide characters": ("<table><tr><td>漢字<td>x<tr><td>abcd<td>y</table>", "漢字  x\nabcd  y"),
    "pre": ("<pre> k\n   l  m</pre>", " k\n   l  m"),
    "hidden": ("a<i hidden>b</i><i style='color:red; DISPLAY: none'>c</i><script>x<y</script><template>d</template>e", "ae"),
    "sheet": ("<style>.h, #k {display:none} /* p{display:none} */ q{visibility:hidden}</style><p class='g H'>a</p><p id=k>b</p><q>c</q><p>d", "d"),
    "head": ("<head><title>t</title><meta name=x><body>a", "a"),
    "no head end": ("<title>t</title><p>a", "a"),
    "details": ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>", "s\nt\ny"),
    "controls": ("<input value=v><input type=hidden value=w><select><option>o<option selected>p</select>", "v p"),
    "quotes and definitions": ("<dl><dt>a<dd>b<dt>c</dl><blockquote>q</blockquote>", "a\n  b\nc\n\n  q"),
    "references": ("a&amp;b &lt;c&gt; &eacute;&nbsp;x &#65;", "a&b <c> é\xa0x A"),
    "stray ends": ("</p></div>a</b></table>b</td>", "ab"),
    "stray in table": ("<table>s<tr>t<td>a</table>", "s\nt\na"),
    "comment": ("a<!-- b --><!doctype html>c", "ac"),
    "empty": ("", ""),
    "white space": (" \n <p> </p> ", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    html, text = CASES[name]
    assert H.visible_text(html) == text


SHEETS = {
    "print": ("@media print { .x, nav { display:none } }", "a"),
    "narrow": ("@media (max-width:600px){ .x{display:none} }", "a"),
    "screen with a condition": ("@media screen and (max-width:600px){ .x{display:none} }", "a"),
    "screen": ("@media print, screen { .x{display:none} }", ""),
    "supports in media": ("@media screen { @supports (x:y) { .x{display:none} } }", "a"),
    "layer": ("@layer b { .x{display:none} }", ""),
    "unlayered beats layer": (".x{display:block} @layer b { .x{display:none} }", "a"),
    "after an at-rule": ("@import url('{;'); @media print{i{color:red}} .x{display:none}", ""),
    "keyframes": ("@keyframes k { from{display:none} .x{display:none} }", "a"),
    "shown again": (".x{display:none} .x{display:block}", "a"),
    "hidden at last": (".x{display:block} .x{visibility:hidden}", ""),
    "both properties": (".x{visibility:hidden} .x{display:block}", ""),
    "important": (".x{display:none!important} .x{display:block}", ""),
    "another selector shows": (".x{display:none} .y{display:block}", "a"),
    "id before class": ("#k{display:none} .x{display:block}", ""),
    "nested": (".x{display:none; .z{color:red} display:block}", "a"),
    "left open": ("p{color:red} .x{display:none", ""),
    "string": (""".x::before{content:"}"} .x{display:none}""", ""),
}


@pytest.mark.parametrize("name", SHEETS)
def test_sheets(name):
    sheet, text = SHEETS[name]
    assert H.visible_text(f"<style>{sheet}</style><p class='x y' id=k>a</p>") == text


def test_inline_style_and_media_of_a_sheet():
    assert H.visible_text("<style>.x{display:none}</style><p class=x style='display:block'>a") == "a"
    assert H.visible_text("<style>.x{display:none!important}</style><p class=x style='display:block'>a") == ""
    assert H.visible_text("<style media=print>.x{display:none}</style><p class=x>a") == "a"
    assert H.visible_text("<p style='display:none;display:block'>a") == "a"


@pytest.mark.parametrize("html,text", [
    ("<table><tr><td>A</td></tr><form><tr><td>B</td></tr></form></table>", "A\nB"),
    ("<table><form><tr><td>A<td>B</td></tr></form></table>", "A  B"),
    ("<table><tr><form><td>A</td><td>B</td></form></tr></table>", "A  B"),
    ("<table><tr><td>A</td></tr><p>Note<tr><td>B</table>", "Note\nA\nB"),
    ("<table><thead><div>n</div><tr><th>A</thead><tbody><tr><td>B</table>", "n\nA\nB"),
    ("<table><tr><td><b>A<tr><td>B</table>c", "A\nB\n\nc"),
    ("<table><tr><td>A<table><p>in<tr><td>B</table><td>C</table>", "A   C\n\nin\nB"),
])
def test_what_does_not_belong_into_a_table(html, text):
    assert H.visible_text(html) == text


def test_drawings_and_formulas():
    assert H.visible_text("a <svg><title>t</title><defs/><desc>d</desc><path/><g><text>x</text><text>y</text></g></svg> b") == "a x y b"
    assert H.visible_text("<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math>, <desc>z</desc>") == "x+1, z"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<tr> <td> </td> </tr> <form> </form> <p> </p> <b> </b> <div> </div> <tbody> </tbody> <thead> <caption> </caption> <table> </table> <svg> </svg>".split()), max_size=20))
def test_no_word_of_a_table_is_lost(tags):
    html = "<table><tr><td>x</td></tr>" + "".join(f"{t} w{i} " for i, t in enumerate(tags))
    assert sorted(H.visible_text(html).split()) == sorted(["x", *(f"w{i}" for i in range(len(tags)))])


def test_null():
    assert H.visible_text(None) == ""


def test_deep_and_wide_pages():
    assert H.visible_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert H.visible_text("<ul><li>" * 5_000 + "x").endswith("x")
    assert H.visible_text("<table><tr><td>" * 3_000 + "x").strip().endswith("x")
    assert len(H.visible_text("<table>" + f"<tr><td>{'w' * 500}<td>y" + "<tr><td>a<td>b" * 2_000)) < 200_000
    assert H.visible_text("<table><tr><td colspan=999999999 rowspan=99999999>a<td>b").split() == ["a", "b"]
    assert H.visible_text("<table>" + "<tr><td colspan=1000 rowspan=65534>a" * 500).split() == ["a"] * 500
    assert H.visible_text("<table><tr><td rowspan=101>x<td>y" + "<tr><td>z" * 102).split("\n")[-3:] == ["   z", "z", "z"]


@pytest.mark.parametrize("depth", [100, 130, 10_000])
@pytest.mark.parametrize("tag", ["div", "b", "blockquote", "ul><li", "table><tr><td"])
def test_what_hides_does_so_at_any_depth(depth, tag):
    inner = "<script>var s</script><style>.h{display:none}</style><p hidden>no</p><p class=h>never</p><p>yes</p>"
    found = H.visible_text(f"<{tag}>" * depth + inner)
    assert found.split()[-1] == "yes" and not set(found.split()) & {"var", "s", "no", "never", ".h{display:none}"}
    assert len(found) < 400 * depth


def test_declarations_and_instructions():
    for odd in ("<![>", "<![-- x -->", "<![0]>", "<!x>", "<!>", "<?php x ?>", "<![CDATA[x]]>", "<![if IE]>", "<!--x--!>", "<!-->", "<!--->"):
        assert H.visible_text(f"a{odd}b") == "ab"
    for odd in ("<![ y", "<!-- y", "<? y", "<!y", "<!["):
        assert H.visible_text(f"a {odd}") == "a"
    assert H.visible_text("<svg><text><![CDATA[a<b]]></text></svg>") == "a<b"
    assert H.visible_text("<p class=h>a<p>b<style>.h{display:none}") == "b"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> <div> </div> <ul> <li> </ul> <table> <tr> <td> </td> </tr> </table> <b> </b> <pre> </pre> <select> <option> <br> <h2> </p> <dl> <dd> &amp; < > x <! <![ <? <!-- --> ]]> <!doctype <![CDATA[ <svg> </svg> <style> </style> <script> </".split() + [" "]), max_size=40).map("".join))
def test_any_markup_is_laid_out(html):
    H.visible_text(html)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("<p> <div> </div> <ul> <li> </ul> <table> <tr> <td> </td> </tr> </table> <b> </b> <br> <h2> </p> <blockquote> <caption> <tbody>".split()), max_size=30))
def test_no_visible_word_is_lost(tags):
    html = "".join(f"{t} w{i} " for i, t in enumerate(tags))
    assert sorted(H.visible_text(html).replace("-", " ").split()) == sorted(f"w{i}" for i in range(len(tags)))


def test_words_of_the_tables_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op10_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.sub(r"<(script|style|title)[^>]*>.*?</\1>|<!--.*?-->", "", pages[r.page_id], flags=re.DOTALL)
        plain = unescape(re.sub(r"<[^>]*>", " ", body))
        drop = lambda t: re.sub(r"[-\s]", "", t)  # noqa: E731  marks of lists aside
        assert drop(r.text) == drop(plain)
        assert r.n_chars == len(r.text) and r.n_lines == r.text.count("\n") + 1


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, "t"), (1, "", "t"), (1, "<p>a", "t"), (1, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in H.extract(pages).collect()) == [("1", ""), ("1", "a"), ("1", "a"), ("None", "")]
    assert H.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("sheet", "body", "text"),
    [
        ("", "<div style='visibility:hidden'>a<span style='visibility:visible'>B</span>c</div>", "B"),
        ("", "<div style='display:none'>a<span style='display:block;visibility:visible'>B</span></div>", ""),
        (".h{visibility:hidden}.s{visibility:visible}", "<ul class=h><li>a<li class=s>b<li>c<b class=s>d</b></ul>", "- b\n  d"),
        ("div.x{display:none}", "<div class=x>a</div><p class=x>b", "b"),
        (".a .b{display:none}", "<div class=a><p><i class=b>1</i></p></div><i class=b>2</i>", "2"),
        (".a > .b{display:none}", "<div class=a><p><i class=b>1</i></p><i class=b>2</i></div>", "1"),
        ("ul > li.x{display:none}", "<ul><li class=x>a<li>b</ul><ol><li class=x>c</ol>", "- b\n\n1. c"),
        ("[hidden]{display:block}", "<p hidden>a", "a"),
        (".row{display:flex}", "<p hidden class=row>a<p hidden>b", "a"),
        ("[data-x]{display:none}[data-y='2']{display:none}[lang|=en]{display:none}", "<p data-x>a<p data-y=2>b<p data-y=3>c<p lang=en-GB>d", "c"),
        ("#k p{display:none}.c.d p{display:block}", "<div id=k class='c d'><p>a</div>", ""),
        (".c.d p{display:none}p{display:block}", "<div class='c d'><p>a</div><div class=c><p>b</div>", "b"),
        ("* .x{display:none}", "<p class=x>a", ""),
        ("p:hover{display:none}p + p{display:none}a,p::before{display:none}", "<p>x<p>y<a>z</a>", "x\n\ny"),
        (".a > .b .c{display:none}", "<div class=b><div class=a><div class=b><div class=b><i class=c>1</i></div></div></div><i class=c>2</i></div>", "2"),
        (".v{visibility:hidden}.v i{visibility:inherit}", "<p class=v>a<i>b</i>", ""),
        (".v{visibility:hidden}", "<table><tr><td class=v>a<td>b<tr><td>c<td class=v>d</table>", "   b\nc"),
    ],
)
def test_rules_above_and_inherited_visibility(sheet, body, text):
    assert H.visible_text(f"<style>{sheet}</style>{body}") == text


def test_noscript_shows_and_lists_count_as_they_say():
    assert H.visible_text("<script>x</script><noscript>plain</noscript>") == "plain"
    assert H.visible_text("<ol type=a start=26><li>x<li>y</ol><ol type=I start=4><li>p</ol><ol type=A><li value=0>q</ol>") == "z. x\naa. y\n\nIV. p\n\n0. q"


def naive(tree, rules, above=(), seen=True):
    """Visible words of a tree of tuples (tag, classes, style, children), by trying every rule on every element."""
    tag, classes, style, children = tree
    path = (*above, (tag, classes))

    def fits(part, element):
        wanted_tag, wanted = part
        return wanted_tag in ("*", element[0]) and wanted <= element[1]

    def stands(parts, at):
        """Whether parts (from the element up, each with whether the next one up is its parent) fit the path up to `at`."""
        (part, child), rest = parts[0], parts[1:]
        if not fits(part, path[at]):
            return False
        return not rest or any(stands(rest, k) for k in ([at - 1] if child else range(at)) if k >= 0)

    best = {}
    for order, (parts, prop, value) in enumerate(rules):
        if stands(parts, len(path) - 1):
            weight = (sum(len(p[1]) for p, _ in parts), sum(p[0] != "*" for p, _ in parts), order)
            if prop not in best or weight > best[prop][0]:
                best[prop] = weight, value
    best |= {prop: ((9,), value) for prop, value in style}
    if best.get("display", (0, ""))[1] == "none":
        return []
    seen = {"hidden": False, "visible": True}.get(best.get("visibility", (0, ""))[1], seen)
    words = []
    for c in children:
        words += ([c] if seen else []) if isinstance(c, str) else naive(c, rules, path, seen)
    return words


CLASSES = st.frozensets(st.sampled_from("abc"), max_size=2)
DECIDES = st.sampled_from([("display", "none"), ("display", "block"), ("visibility", "hidden"), ("visibility", "visible")])
TREES = st.recursive(
    st.builds(lambda t, c, s: (t, c, s, ["w"]), st.sampled_from(["div", "span"]), CLASSES, st.lists(DECIDES, max_size=1)),
    lambda inner: st.builds(lambda t, c, s, k: (t, c, s, k), st.sampled_from(["div", "section"]), CLASSES, st.lists(DECIDES, max_size=1), st.lists(st.one_of(inner, st.just("w")), max_size=4)),
    max_leaves=14,
)
RULES = st.lists(st.tuples(st.lists(st.tuples(st.tuples(st.sampled_from(["*", "div", "span"]), CLASSES), st.booleans()), min_size=1, max_size=3), DECIDES).map(lambda x: (x[0], *x[1])), max_size=5)


@settings(max_examples=400, deadline=None)
@given(TREES, RULES)
def test_generated_trees_like_every_rule_on_every_element(tree, rules):
    counter = iter(range(10_000))

    def numbered(t):
        return (*t[:3], [f"w{next(counter)}" if isinstance(c, str) else numbered(c) for c in t[3]])

    def html(t):
        tag, classes, style, children = t
        return f"<{tag} class='{' '.join(sorted(classes))}' style='{';'.join(f'{p}:{v}' for p, v in style)}'>" + " ".join(c if isinstance(c, str) else html(c) for c in children) + f"</{tag}>"

    def css(parts):
        out = ""
        for k, ((tag, classes), child) in enumerate(parts):
            one = (tag if tag != "*" or not classes else "") + "".join(f".{c}" for c in sorted(classes))
            out = one + ((" > " if parts[k - 1][1] else " ") + out if k else "")
        return out

    tree = numbered(tree)
    sheet = "".join(f"{css(parts)}{{{prop}:{value}}}" for parts, prop, value in rules)
    # the page's own html and body are above the tree
    want = naive(("html", frozenset(), [], [("body", frozenset(), [], [tree])]), rules)
    assert H.visible_text(f"<html><head><style>{sheet}</style></head><body>{html(tree)}</body></html>").split() == want
