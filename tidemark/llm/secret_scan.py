"""Secret scan: certain findings by pattern, and multipart credentials linked across a scope.

Certain kinds (assign, access, hex) are reported wherever they stand. A credential often comes in
parts, none of which proves anything by itself: an identifier (`user = ...`), a secret-looking token,
an endpoint (`https://...`, `db.example.org:5432`). Such weak candidates are reported only where
complementary parts co-occur: the spans of a text, sorted by start, are interval-joined with the spans
within `reach` code points of each other and in the same paragraph, and a weak candidate stays if its
scope also holds parts that complete it. Parts are disjoint: characters that were read as one are no
other part (a token in a URL's path is the URL's, an identifier's value the identifier's).

    secret    next to an identifier or an access key
    id        next to a secret (weak or assigned), and so on for a user name
    endpoint  next to an identifier and a secret

Spans are code points, end exclusive. Each text is scanned whole, in one task, with memory in
proportion to it.

Defined results: a null text is the empty text, without spans; spans that tie on start are ordered as
the kinds are listed; repeated rows and null ids are scanned like any other row; an empty table gives
an empty result; `redact` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batches, ship, table

#: Kinds in the order in which spans of one start are listed: three certain, then three weak ones.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "id", "secret", "endpoint")
#: Code points between two parts of a credential, at most.
REACH = 300

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without any of these, in lower case, has no assignment.
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ID = re.compile(r"\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})", re.ASCII | re.IGNORECASE)
_ID_HINTS = ("user", "login", "client", "account", "keyid", "key_id")
#: Tokens that may be secrets: 20 or more characters of the base64 alphabets.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])", re.ASCII)
ENDPOINT = re.compile(r"\b(?:https?|wss?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s\"'<>]+|(?<![\w.-])(?:[a-z0-9-]++\.)++[a-z]{2,}+:\d{2,5}\b|(?<![\w.-])(?:localhost|(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)):\d{2,5}\b", re.ASCII)
#: A name and a password before the host of an address.
USERINFO = re.compile(r"://([^\s/@:?#]+):([^\s/@?#]{3,})@")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The certain spans, by start, then kind."""
    found: list[Span] = []
    low = text.lower() if any(c in text for c in ":=") else ""
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def looks_random(token: str) -> bool:
    """Mixed classes and few repeats: two of lower case, upper case and digits, with many distinct characters."""
    return sum(bool(re.search(x, token)) for x in ("[0-9]", "[a-z]", "[A-Z]")) >= 2 and len(set(token)) >= 10


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that share no character with any of `taken`."""
    taken = sorted(taken)
    starts, ends = [s for s, _, _ in taken], []
    for _, e, _ in taken:
        ends.append(max(e, ends[-1]) if ends else e)
    return [x for x in spans if (k := bisect_left(starts, x[1])) == 0 or ends[k - 1] <= x[0]]


def weak_spans(text: str, certain: list[Span]) -> list[Span]:
    """Candidates that need company. No two of them, and none and a certain span, share a character: one part is read once.

    What an endpoint or an identifier's value is made of is that part and no second one. Only an address of
    the form scheme://user:password@host holds three parts: the name, the password, and what follows.
    """
    low = text.lower() if any(c in text for c in ":=") else ""
    endpoints = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if ":" in text else []
    parts: list[Span] = []
    for s, e, kind in endpoints:
        m = USERINFO.search(text, s, e) if "@" in text[s:e] else None
        parts += [(*m.span(1), "id"), (*m.span(2), "secret"), (m.end(), e, kind)] if m and m.end() < e else [(s, e, kind)]
    ids = [(m.start(), m.end(), "id") for m in ID.finditer(text)] if any(h in low for h in _ID_HINTS) else []
    ids = _apart(ids, endpoints)
    tokens = [(m.start(), m.end(), "secret") for m in TOKEN.finditer(text) if looks_random(m[0])]
    return _apart(ids + parts + _apart(tokens, ids + endpoints), certain)


#: What must stand in the scope of a weak candidate: one kind of each group (fixed values of this design).
NEEDS = {"secret": (("id", "access"),), "id": (("secret", "assign"),), "endpoint": (("id", "access"), ("secret", "assign"))}


def linked(text: str, certain: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """The weak spans whose scope holds their complement: an interval join of spans with their scopes."""
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    at: dict[str, tuple[list[int], list[int]]] = {}  # starts and ends, both ascending: spans of one kind do not overlap
    for s, e, kind in sorted(certain + weak, key=_order):
        starts, ends = at.setdefault(kind, ([], []))
        starts.append(s)
        ends.append(e)

    def near(kind: str, low: int, high: int) -> bool:
        starts, ends = at.get(kind, ([], []))
        k = bisect_right(ends, low)
        return k < len(starts) and starts[k] <= high

    kept = []
    for s, e, kind in weak:
        k = bisect_right(breaks, s)
        low = max(s - reach, breaks[k - 1] if k else 0)
        high = min(e + reach, breaks[k] if k < len(breaks) else len(text))
        if all(any(near(other, low, high) for other in group) for group in NEEDS[kind]):
            kept.append((s, e, kind))
    return kept


def scan(text: str, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """(certain spans, all spans), each by start, then kind."""
    certain = base_spans(text)
    return certain, sorted(certain + linked(text, certain, weak_spans(text, certain), reach), key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string())])
_FOUND_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def scan_documents(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Counts of the certain kinds, the certain spans and all spans of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    certain, spans = scan(text or "", reach)
                    kinds = [k for _, _, k in certain]
                    yield doc_id, *(kinds.count(k) for k in BASE_KINDS), joined(certain), joined(spans)

        yield from record_batches(rows(), _FOUND)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND_DDL)


def redacted(text: str, reach: int = REACH) -> str:
    """The text with each group of overlapping spans replaced by [its first span's kind]."""
    out, at = [], 0
    for s, e, kind in scan(text, reach)[1]:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """All rows and columns of docs, secrets replaced in `text` and n_chars, if there, counted anew."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            old = columns[at].to_pylist()
            texts = [x and redacted(x, reach) for x in old]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if count_at is not None:
                counts = zip(columns[count_at].to_pylist(), old, texts, strict=True)
                columns[count_at] = pa.array([n if x == y else len(y) for n, x, y in counts], b.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4_secret_scan's certain kinds, which SQL can express too."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_EITHER_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else "_?" for c in word) for word in ("password", "passwd", "secret", "token", "api_key"))
BASE_COUNTS_SQL = rf"""
WITH found AS (
  SELECT doc_id,
    regexp_extract_all(coalesce(text, ''), '({_EITHER_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS assigned,
    regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') AS keys,
    regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') AS digits
  FROM documents
)
SELECT doc_id, CAST(len(list_filter(assigned, lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(keys, lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(digits, lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM found
"""
