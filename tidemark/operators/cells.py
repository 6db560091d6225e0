"""Cells that two distributions share: quantile bins of the reference, or categories."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .twosample import quantiles

POOLED = "<pooled rare categories>"


def quantile_edges(summed: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, constant, edges): interior quantiles of the reference, each once, in order, from twosample.cumulative.

    A constant reference has `constant` set, and no edges: its cells are below, equal and above.
    Features without reference values have no row.
    """
    inner = quantiles(summed, [k / n_bins for k in range(1, n_bins)])
    edges = inner.groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("edges"))  # n_bins - 1 values
    ends = summed.where("n_reference > 0").groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    same = F.col("low") == F.col("high")
    return ends.join(edges, "feature").select("feature", F.when(same, F.col("low")).alias("constant"), F.when(same, F.array().cast("array<double>")).otherwise(F.col("edges")).alias("edges"))


def cell_of(value: str) -> Column:
    """A value's cell, beside the columns of quantile_edges."""
    return F.when(F.col("constant").isNull(), F.size(F.filter("edges", lambda e: e <= F.col(value)))).otherwise(F.signum(F.col(value) - F.col("constant")).cast("int") + 1)


def numeric_cells(summed: DataFrame, n_bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(feature, cell, n_reference, n_current, p_reference, p_current): all cells, empty ones too.

    Cell k holds values from edge k - 1 up to, but not at, edge k. Cells are sums over distinct values.
    Edges that are not given are computed once and held as n_bins - 1 numbers a feature.
    """
    if edges is None:
        rows = [tuple(r) for r in quantile_edges(summed, n_bins).collect()]
        edges = summed.sparkSession.createDataFrame(rows, "feature string, constant double, edges array<double>")
    counted = summed.join(F.broadcast(edges), "feature").groupBy("feature", cell_of("v").alias("cell")).agg(F.sum("n_reference").alias("n_reference"), F.sum("n_current").alias("n_current"))
    last = F.when(F.col("constant").isNull(), F.size("edges")).otherwise(2)
    every = edges.select("feature", F.explode(F.sequence(F.lit(0), last)).alias("cell"))
    full = every.join(counted, ["feature", "cell"], "left").fillna(0, ["n_reference", "n_current"])
    return with_shares(full)


def edges_frame(spark: SparkSession, edges: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """quantile_edges from rows by feature."""
    return spark.createDataFrame([(n, e["constant"], e["edges"]) for n, e in edges.items()], "feature string, constant double, edges array<double>")


def category_cells(long: DataFrame) -> DataFrame:
    """(feature, cell, n_reference, n_current, p_reference, p_current): each category of either side."""
    counted = long.groupBy("feature", F.col("category").alias("cell")).agg(
        F.count(F.when(F.col("is_reference"), 1)).alias("n_reference"), F.count(F.when(~F.col("is_reference"), 1)).alias("n_current")
    )
    return with_shares(counted)


def with_shares(cells: DataFrame) -> DataFrame:
    """Adds each side's share of its feature's total; null where a side has nothing."""
    totals = cells.groupBy("feature").agg(F.sum("n_reference").alias("t_reference"), F.sum("n_current").alias("t_current"))
    share = lambda side: F.when(F.col(f"t_{side}") > 0, F.col(f"n_{side}") / F.col(f"t_{side}")).alias(f"p_{side}")
    return cells.join(F.broadcast(totals), "feature").select("feature", "cell", "n_reference", "n_current", share("reference"), share("current"))
