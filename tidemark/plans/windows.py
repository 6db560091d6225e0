"""analyze of many windows against one reference, in as many jobs as one window takes.

What all windows need of the reference (an index of its values, counts of its categories and cells, profile,
repeated rows, edges of the bins) is computed once and kept as tables. A window's feature is a feature of its own
in the long frames, so one job serves all windows. The work, and what is shuffled, is in proportion to the windows'
rows and, for every window, to the reference's distinct categories; numeric values of the reference are looked up in
its index, not joined. Adversarial validation, where configured, fits a model per window and so runs jobs per window.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import validate_config
from ..contracts import SIDES
from ..functions.canonical import quoted
from ..operators import cells, stability
from ..operators.distribution_index import Index, sample_distances
from ..operators.longform import category_values, numeric_values
from ..operators.quality import duplicates, profile
from ..operators.running import running_sums
from ..schema import validate_schema
from .analysis import document, profiles_of, repeated_rows, rows_by_feature, statistics_of_cells, together, valid_by_kind

#: Stands between a window and a feature's name.
SEPARATOR = "\x1f"


class Counted(NamedTuple):
    """What is kept of a reference, before it is written. values: (name, v, n); categories: (name, cell, n); facts: profile, repeated rows, edges and cells by name."""

    values: DataFrame
    categories: DataFrame
    facts: dict[str, Any]

    def write(self, path: str) -> None:
        """The facts come last: where they are, all is."""
        Index.write(self.values, f"{path}/index")
        self.categories.write.mode("overwrite").parquet(f"{path}/categories")
        rows = [(json.dumps(self.facts),)]
        self.values.sparkSession.createDataFrame(rows, "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


class Kept(NamedTuple):
    index: Index
    categories: DataFrame
    facts: dict[str, Any]

    @staticmethod
    def read(spark: SparkSession, path: str) -> Kept:
        facts = json.loads(spark.read.schema("facts string").parquet(f"{path}/facts").first()[0])
        return Kept(Index.read(spark, f"{path}/index"), spark.read.schema("name string, cell string, n long").parquet(f"{path}/categories"), facts)


def keep(reference: DataFrame, config: Mapping[str, Any]) -> Counted:
    """What comparisons need of a reference that has rows and fits the schema."""
    config = validate_config(config)
    schema = validate_schema(reference, reference, config["schema"])
    specs = {n: config["schema"]["features"][n] for n in schema["valid_features"]}
    numeric, categorical = (valid_by_kind(config, schema, k) for k in ("numeric", "categorical"))
    none = reference.sparkSession.createDataFrame
    values = numeric_values(reference, numeric).groupBy(F.col("feature").alias("name"), "v").agg(F.count("*").alias("n")) if numeric else none([], "name string, v double, n long")
    named = category_values(reference, categorical).groupBy(F.col("feature").alias("name"), F.col("category").alias("cell")).agg(F.count("*").alias("n")) if categorical else none([], "name string, cell string, n long")

    def binned() -> dict[str, dict[str, Any]]:
        """Edges and the reference's count of every cell."""
        if not numeric:
            return {}
        one_sided = values.select(F.col("name").alias("feature"), "v", F.col("n").alias("n_reference"), F.lit(0).cast("long").alias("n_current"))
        summed = running_sums(one_sided, "feature", "v", ["n_reference"])
        edges = {r["feature"]: r.asDict() for r in cells.quantile_edges(summed, config["drift"]["n_bins"]).collect()}
        counted = cells.numeric_cells(summed, edges=cells.edges_frame(summed.sparkSession, edges)).orderBy("feature", "cell").collect()  # a row per feature and bin
        for name, e in edges.items():
            e["counts"] = [r["n_reference"] for r in counted if r["feature"] == name]
        return edges

    profiles, repeated, edges = together(
        lambda: profiles_of({"reference": reference}, specs)["reference"],
        lambda: repeated_rows({"reference": reference})["reference"],
        binned,
    )
    return Counted(values, named, {"profiles": profiles, "repeated": repeated, "edges": edges})


def _counts(kept: DataFrame, own: DataFrame, asked: DataFrame, value: str) -> DataFrame:
    """(feature, value, n_reference, n_current) of the windows' features that are asked for."""
    asked = F.broadcast(asked)  # a row per window of a block and feature
    theirs = kept.join(asked, "name").select("feature", value, F.col("n").alias("n_reference"), F.lit(0).cast("long").alias("n_current"))
    ours = own.join(asked, ["window", "name"]).groupBy("feature", value).agg(F.lit(0).cast("long").alias("n_reference"), F.count("*").alias("n_current"))
    return theirs.unionByName(ours).groupBy("feature", value).agg(F.sum("n_reference").alias("n_reference"), F.sum("n_current").alias("n_current"))


def _sample_cells(samples: DataFrame, asked: DataFrame, edges: Mapping[str, Any]) -> DataFrame:
    """What cells.numeric_cells gives, for samples (feature, name, v) and the reference's kept counts: the reference's values are not gone through."""
    rows = [(n, e["constant"], e["edges"], e["counts"]) for n, e in edges.items()]
    kept = F.broadcast(samples.sparkSession.createDataFrame(rows, "name string, constant double, edges array<double>, counts array<long>"))  # a row per feature
    counted = samples.join(kept, "name").groupBy("feature", cells.cell_of("v").alias("cell")).agg(F.count("*").alias("n_current"))
    every = asked.join(kept, "name").select("feature", F.posexplode("counts").alias("cell", "n_reference"))
    return cells.with_shares(every.join(counted, ["feature", "cell"], "left").fillna(0, ["n_current"]))


def by_window(found: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    out: dict[str, dict[str, Any]] = defaultdict(dict)
    for feature, x in found.items():
        window, name = feature.split(SEPARATOR, 1)
        out[window][name] = x
    return out


def analyze_windows(reference: DataFrame, kept: Kept, current: DataFrame, window: str, columns: Mapping[str, list[str]], config: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """By window, what analyze gives for its rows.

    current: the rows of all windows, told apart by the column `window`, which holds no SEPARATOR;
    columns: each window's own columns in order. A column that a window lacks is null in its rows.
    Windows without rows have no result.
    """
    config = validate_config(config)
    drift, none_empty = config["drift"], dict.fromkeys(SIDES, False)
    shapes = {names: current.select(*[quoted(n) for n in names]) for names in {tuple(c) for c in columns.values()}}
    schemas = {names: validate_schema(reference, f, config["schema"], none_empty) for names, f in shapes.items()}
    of = {w: schemas[tuple(c)] for w, c in columns.items()}
    asked: dict[str, list[tuple[str, str, str]]] = {
        kind: [(f"{w}{SEPARATOR}{n}", w, n) for w, schema in of.items() for n in valid_by_kind(config, schema, kind)] for kind in ("numeric", "categorical")
    }
    names = {kind: sorted({n for _, _, n in rows}) for kind, rows in asked.items()}
    specs = {n: config["schema"]["features"][n] for n in names["numeric"] + names["categorical"]}
    frame = lambda kind: current.sparkSession.createDataFrame(asked[kind], "feature string, window string, name string")
    own = lambda f, value: f.select(F.col(quoted(window)).alias("window"), F.col("feature").alias("name"), value)

    def numeric() -> list[dict]:
        if not asked["numeric"] or not drift["numeric_methods"]:
            return [{}, {}, {}]
        wanted = frame("numeric")
        samples = own(numeric_values(current, names["numeric"], window), F.col("v")).join(F.broadcast(wanted), ["window", "name"]).select("feature", "name", "v").persist()  # a row per window of a block and feature is broadcast
        edges = {f: kept.facts["edges"][n] for f, _, n in asked["numeric"] if n in kept.facts["edges"]}
        try:
            distances, stable = together(
                lambda: rows_by_feature(sample_distances(kept.index, samples)) if {"ks", "wasserstein"} & set(drift["numeric_methods"]) else {},
                lambda: rows_by_feature(stability.psi_js(_sample_cells(samples, wanted, kept.facts["edges"]), drift["psi_smoothing"], drift["js_base"])) if {"psi", "js"} & set(drift["numeric_methods"]) else {},
            )
        finally:
            samples.unpersist()
        return [by_window(x) for x in (distances, stable, edges)]

    def categories() -> list[dict]:
        if not asked["categorical"] or not drift["categorical_methods"]:
            return [{}, {}, {}, {}]
        counts = _counts(kept.categories, own(category_values(current, names["categorical"], window), F.col("category").alias("cell")), frame("categorical"), "cell")
        return [by_window(x) for x in statistics_of_cells(cells.with_shares(counts), [f for f, _, _ in asked["categorical"]], drift)]

    def profiled() -> dict[str, dict[str, Any]]:
        out: dict[str, dict[str, Any]] = defaultdict(dict)
        for r in profile(current.select(quoted(window), *[quoted(n) for n in specs]), specs, window).collect() if specs else []:
            row = r.asDict()
            out[row.pop(window)][row["feature"]] = row
        return out

    def repeated() -> dict[str, dict[str, Any]]:
        rows = [r.asDict() for r in duplicates(current, window).collect()]
        return {r.pop(window): r for r in rows}

    found_numeric, found_categories, profiles, doubled = together(numeric, categories, profiled, repeated)
    out = {}
    for w, schema in of.items():
        if w not in doubled:
            continue
        rows = {"reference": kept.facts["repeated"]["rows"], "current": doubled[w]["rows"]}
        sides = {"reference": {n: kept.facts["profiles"][n] for n in schema["valid_features"]}, "current": {n: profiles[w][n] for n in schema["valid_features"]}}
        alone = current.where(F.col(quoted(window)) == w).select(*[quoted(n) for n in columns[w]])
        both = {"reference": kept.facts["repeated"], "current": doubled[w]}
        out[w] = document(config, reference, alone, schema, none_empty, sides, both, tuple(x.get(w, {}) for x in found_numeric), tuple(x.get(w, {}) for x in found_categories), rows)
    return out
