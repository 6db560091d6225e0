"""analyze of many pairs of tables, told apart by a column, in as many jobs as one pair takes.

Both sides are grouped by pair in the long frames: a pair's feature is a feature of its own. BLOCK pairs share their
jobs, which bounds what is broadcast (a row per pair of a block and feature) and what comes to the driver (a
document per pair). Adversarial validation, where configured, fits a model per pair and so runs jobs per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import default_config, validate_config
from ..contracts import SIDES
from ..functions.canonical import quoted
from ..functions.lineage import cut
from ..operators import cells
from ..operators.longform import category_values, numeric_values
from ..operators.quality import duplicates, profile
from ..operators.twosample import cumulative
from ..schema import require_frames, validate_schema
from .analysis import analyze, document, statistics_of_cells, statistics_of_sums, together, valid_by_kind
from .windows import SEPARATOR, by_window

#: Pairs that are analysed together.
BLOCK = 1_000


def analyze_pairs(reference: DataFrame, current: DataFrame, pair: str, config: Mapping[str, Any] | None = None) -> Iterator[tuple[str, dict[str, Any]]]:
    """(pair, what analyze gives for its rows of both sides), in the order of pairs.

    pair: a column of texts without SEPARATOR, which both sides have; other columns may be the same as those of any
    two tables. Rows without a pair take no part; a pair with rows on one side only is compared with an empty table.
    """
    require_frames(reference, current)
    frames = dict(zip(SIDES, (cut(reference), cut(current)), strict=True))
    config = validate_config(default_config(reference.drop(pair)) if config is None else config)
    column = F.col(quoted(pair))
    names = frames["reference"].select(column).union(frames["current"].select(column)).where(F.col(quoted(pair)).isNotNull()).distinct().orderBy(pair)
    if SEPARATOR in "".join(r[0] for r in names.where(column.contains(SEPARATOR)).limit(1).collect()):
        raise ValueError("a pair's name holds the separator")
    last = None
    while True:
        block = [r[0] for r in (names if last is None else names.where(column > last)).limit(BLOCK).collect()]
        if not block:
            return
        last = block[-1]
        # a range of names reaches the scan
        yield from _block({s: f.where((column >= block[0]) & (column <= last)) for s, f in frames.items()}, pair, block, config)


def _block(frames: Mapping[str, DataFrame], pair: str, block: list[str], config: Mapping[str, Any]) -> Iterator[tuple[str, dict[str, Any]]]:
    drift, none_empty = config["drift"], dict.fromkeys(SIDES, False)
    bare = {s: f.drop(pair) for s, f in frames.items()}
    schema = validate_schema(bare["reference"], bare["current"], config["schema"], none_empty)
    specs = {n: config["schema"]["features"][n] for n in schema["valid_features"]}
    by_kind = {k: valid_by_kind(config, schema, k) for k in ("numeric", "categorical")}

    def long(values, names: list[str], what: str) -> DataFrame:
        own = F.concat(F.col(quoted(pair)), F.lit(SEPARATOR), F.col("feature")).alias("feature")
        sides = [values(f, names, pair).select(own, F.lit(s == "reference").alias("is_reference"), what) for s, f in frames.items()]
        return sides[0].unionByName(sides[1])

    def numeric() -> list[dict]:
        if not by_kind["numeric"] or not drift["numeric_methods"]:
            return [{}, {}, {}]
        return [by_window(x) for x in statistics_of_sums(cumulative(long(numeric_values, by_kind["numeric"], "v")), drift)]

    def categories() -> list[dict]:
        if not by_kind["categorical"] or not drift["categorical_methods"]:
            return [{}, {}, {}, {}]
        every = [f"{p}{SEPARATOR}{n}" for p in block for n in by_kind["categorical"]]
        return [by_window(x) for x in statistics_of_cells(cells.category_cells(long(category_values, by_kind["categorical"], "category")), every, drift)]

    def profiled(side: str) -> dict[str, dict[str, Any]]:
        out: dict[str, dict[str, Any]] = {}
        for r in profile(frames[side].select(quoted(pair), *[quoted(n) for n in specs]), specs, pair).collect() if specs else []:
            row = r.asDict()
            out.setdefault(row.pop(pair), {})[row["feature"]] = row
        return out

    def repeated(side: str) -> dict[str, dict[str, Any]]:
        rows = [r.asDict() for r in duplicates(frames[side], pair).collect()]
        return {r.pop(pair): r for r in rows}

    found_numeric, found_categories, *rest = together(numeric, categories, *[lambda s=s: profiled(s) for s in SIDES], *[lambda s=s: repeated(s) for s in SIDES])
    profiles, doubled = dict(zip(SIDES, rest[:2], strict=True)), dict(zip(SIDES, rest[2:], strict=True))
    for p in block:
        own = {s: f.where(F.col(quoted(pair)) == p).drop(pair) for s, f in frames.items()}
        if any(p not in doubled[s] for s in SIDES):
            yield p, analyze(own["reference"], own["current"], config)
            continue
        both = {s: doubled[s][p] for s in SIDES}
        sides = {s: {n: profiles[s][p][n] for n in specs} for s in SIDES}
        rows = {s: both[s]["rows"] for s in SIDES}
        yield p, document(config, own["reference"], own["current"], schema, none_empty, sides, both, tuple(x.get(p, {}) for x in found_numeric), tuple(x.get(p, {}) for x in found_categories), rows)
