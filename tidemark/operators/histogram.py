"""Distributions for display: equal-width bins and category shares. Not for PSI or JS."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BINS = 30


def bin_count(n: int, low: float, high: float, quartile_range: float) -> int:
    """The larger of Sturges' and Freedman-Diaconis' numbers, from 1 to MOST_BINS."""
    if n < 1 or high <= low:
        return 1
    sturges = math.log2(n) + 1
    diaconis = (high - low) / (2 * quartile_range / n ** (1 / 3)) if quartile_range > 0 else 0.0
    return min(max(math.ceil(max(sturges, diaconis)), 1), MOST_BINS)


def edges_of(low: float, high: float, bins: int) -> list[float]:
    """A constant gets one bin, wider by 5 % or 0.5 on either side."""
    if low == high:
        pad = max(abs(low) * 0.05, 0.5)
        return [low - pad, high + pad]
    return [low + (high - low) * k / bins for k in range(bins)] + [high]


def equal_width(long: DataFrame, feature: str, bins: int | None = None) -> DataFrame:
    """(side, bin, left, right, n, fraction) over the range of both sides; the last bin holds its end."""
    rows = long.where(F.col("feature") == feature)
    r = rows.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", [0.25, 0.75], 100_000).alias("q")).first()
    schema = "side string, bin int, left double, right double, n long, fraction double"
    if not r["n"]:
        return long.sparkSession.createDataFrame([], schema)
    edges = edges_of(r["low"], r["high"], bins or bin_count(r["n"], r["low"], r["high"], r["q"][1] - r["q"][0]))
    last = len(edges) - 2
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]) if last else F.array().cast("array<double>")
    place = F.size(F.filter(inner, lambda e: e <= F.col("v")))
    counted = rows.groupBy("is_reference", place.alias("bin")).agg(F.count("*").alias("n"))
    bounds = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(edges[k]).alias("left"), F.lit(edges[k + 1]).alias("right")) for k in range(last + 1)])
    every = long.sparkSession.range(2).select((F.col("id") == 0).alias("is_reference"), F.explode(bounds).alias("x")).select("is_reference", "x.*")
    full = every.join(counted, ["is_reference", "bin"], "left").fillna(0, ["n"])
    totals = counted.groupBy("is_reference").agg(F.sum("n").alias("total"))
    side = F.when(F.col("is_reference"), "reference").otherwise("current")
    return full.join(F.broadcast(totals), "is_reference", "left").select(side.alias("side"), "bin", "left", "right", "n", (F.col("n") / F.col("total")).alias("fraction"))


def category_shares(cells: DataFrame) -> DataFrame:
    """category_cells with their place: most rows first, then by name; per feature."""
    from pyspark.sql import Window

    order = Window.partitionBy("feature").orderBy(F.desc(F.col("n_reference") + F.col("n_current")), "cell")
    return cells.withColumn("place", F.row_number().over(order))
