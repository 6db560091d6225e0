"""Two-sample statistics of numeric features: Kolmogorov-Smirnov D, Wasserstein-1, order statistics.

All of them read one frame, `cumulative`: a row per feature and distinct value, with both sides' counts
and running counts. The rows of the tables are gone through once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sums


def value_counts(long: DataFrame) -> DataFrame:
    """(feature, v, n_reference, n_current), one row per distinct value."""
    one = lambda side: F.sum(F.when(side, 1).otherwise(0)).alias
    return long.groupBy("feature", "v").agg(one(F.col("is_reference"))("n_reference"), one(~F.col("is_reference"))("n_current"))


def cumulative(long: DataFrame) -> DataFrame:
    """value_counts of (feature, is_reference, v), with n_reference_upto, n_current_upto and next_v."""
    return running_sums(value_counts(long), "feature", "v", ["n_reference", "n_current"])


def ks_wasserstein(summed: DataFrame) -> DataFrame:
    """feature, n_reference, n_current, ks, location, sign, wasserstein, from cumulative counts.

    location is the smallest value at which the difference is largest; sign is 1 if the reference's
    distribution function is the larger one there, else -1. Null where a side has no values.
    """
    totals = summed.groupBy("feature").agg(F.sum("n_reference").alias("total_reference"), F.sum("n_current").alias("total_current"))
    share = lambda side: F.when(F.col(f"total_{side}") > 0, F.col(f"n_{side}_upto") / F.col(f"total_{side}"))
    d = summed.join(F.broadcast(totals), "feature").withColumn("gap", share("reference") - share("current"))  # a row per feature
    at = F.min_by(F.struct("v", "gap"), F.struct(-F.abs("gap"), "v"))
    return (
        d.groupBy("feature")
        .agg(
            F.max("total_reference").alias("n_reference"),
            F.max("total_current").alias("n_current"),
            F.max(F.abs("gap")).alias("ks"),
            at.alias("at"),
            F.sum(F.abs("gap") * F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0))).alias("wasserstein"),
        )
        .select(
            "feature", "n_reference", "n_current", "ks", F.when(F.col("ks").isNotNull(), F.col("at.v")).alias("location"),
            F.when(F.col("at.gap") > 0, 1).when(F.col("at.gap") <= 0, -1).alias("sign"), "wasserstein",
        )
    )


def quantiles(summed: DataFrame, fractions: list[float], group: str = "feature", value: str = "v", n: str = "n_reference") -> DataFrame:
    """(group, fraction, quantile) of `n` counted values: exact, with linear interpolation between ranks.

    The values at the wanted ranks are picked from running counts, so no task sorts a whole group.
    """
    totals = summed.groupBy(group).agg(F.sum(n).alias("total")).where("total > 0")
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in fractions]))
    place = F.col("fraction") * (F.col("total") - 1)
    ranks = totals.withColumn("fraction", wanted).select(group, "fraction", F.floor(place).alias("low"), F.ceil(place).alias("high"), (place - F.floor(place)).alias("part"))
    if group == "feature":  # a row per feature and fraction; other groups may be many, so Spark decides
        ranks = F.broadcast(ranks)
    hit = summed.where(F.col(n) > 0).join(ranks, group)
    inside = lambda r: (F.col(r) < F.col(f"{n}_upto")) & (F.col(r) >= F.col(f"{n}_upto") - F.col(n))
    found = hit.where(inside("low") | inside("high")).groupBy(group, "fraction", "part").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return found.select(group, "fraction", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, quantile): each group's median of its values that are there."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    return quantiles(running_sums(counts, group, "v", ["n"]), [0.5], group, n="n").drop("fraction")


def roc_auc(scored: DataFrame, group: str = "feature", label: str = "label", score: str = "score") -> DataFrame:
    """(group, n_positive, n_negative, roc_auc): exact, ties count half; null where a class is missing."""
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(group, F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    sums = running_sums(counts, group, "s", ["neg"]).groupBy(group).agg(F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"), wins.alias("wins"))
    both = F.col("n_positive") * F.col("n_negative")
    return sums.select(group, "n_positive", "n_negative", F.when(both > 0, F.col("wins") / both).alias("roc_auc"))
