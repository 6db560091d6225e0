"""Data-quality aggregates of one table: one pass for all features, one grouping for duplicate rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import as_double, canonical, column, is_finite, quoted
from ..functions.decide import exceeds_column

COUNTS = ("rows", "missing", "positive_infinities", "negative_infinities", "finite", "least", "largest", "below_min", "above_max")


def profile(frame: DataFrame, features: Mapping[str, Mapping], by: str | None = None) -> DataFrame:
    """A row per feature, and per value of `by`, with COUNTS; features map names to {kind, min?, max?}.

    Missing is null or NaN. Counts of numbers are null for categorical features; below_min and above_max
    count finite values beyond the bounds, and are null where there is no bound.
    """
    structs = []
    for name, spec in features.items():
        numeric = spec["kind"] == "numeric"
        v = as_double(name) if numeric else F.lit(None).cast("double")
        present = v if numeric else column(name)
        finite = F.when(is_finite(v), v)
        count = lambda c: F.count(F.when(c, 1)) if numeric else F.lit(None).cast("long")  # noqa: E731,B023
        bound = lambda key, beyond: count(beyond) if key in spec else F.lit(None).cast("long")  # noqa: E731,B023
        structs.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.count("*").alias("rows"),
                F.count(F.when(present.isNull(), 1)).alias("missing"),
                count(v == float("inf")).alias("positive_infinities"),
                count(v == float("-inf")).alias("negative_infinities"),
                count(finite.isNotNull()).alias("finite"),
                F.min(finite).alias("least"),
                F.max(finite).alias("largest"),
                bound("min", finite < float(spec.get("min", 0))).alias("below_min"),
                bound("max", finite > float(spec.get("max", 0))).alias("above_max"),
            )
        )
    kept = [by] if by else []
    return frame.groupBy(*kept).agg(F.array(*structs).alias("_x")).select(*kept, F.explode("_x").alias("_x")).select(*kept, "_x.*")


def duplicates(frame: DataFrame, by: str | None = None) -> DataFrame:
    """One row, or one per value of `by`: rows, duplicate_count (rows after the first of equal ones), duplicate_fraction."""
    same = canonical(frame).groupBy(*[quoted(c) for c in frame.columns]).agg(F.count("*").alias("__n"))
    sums = same.groupBy(*([by] if by else [])).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_count"))
    return sums.withColumn("duplicate_fraction", F.when(F.col("rows") > 0, F.col("duplicate_count") / F.col("rows")))


def missing_increase(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, reference_fraction, current_fraction, increase_pp) from two profiles."""
    share = lambda p, side: p.select("feature", (F.col("missing") / F.col("rows")).alias(f"{side}_fraction"))
    both = share(reference, "reference").join(share(current, "current"), "feature")
    return both.withColumn("increase_pp", F.round((F.col("current_fraction") - F.col("reference_fraction")) * 100.0, 12))


def checks(profiled: DataFrame, side: str, features: Mapping[str, Mapping], max_missing_fraction: float) -> DataFrame:
    """(feature, check, value, threshold, alert, status) of one side, a row per check that applies."""
    nullable = F.create_map(*[x for n, s in features.items() for x in (F.lit(n), F.lit(bool(s.get("nullable", True))))])
    bounds = {k: F.create_map(*[x for n, s in features.items() for x in (F.lit(n), F.lit(float(s[k]) if k in s else None).cast("double"))]) for k in ("min", "max")}
    kind = F.create_map(*[x for n, s in features.items() for x in (F.lit(n), F.lit(s["kind"]))])
    allowed = F.when(nullable[F.col("feature")], float(max_missing_fraction)).otherwise(0.0)
    missing = F.col("missing") / F.col("rows")
    infinite = (F.col("positive_infinities") + F.col("negative_infinities")).cast("double")

    def row(check: str, value, threshold, alert, bad):
        status = F.when(alert.isNull(), "skipped").when(alert, bad).otherwise("ok")
        return F.struct(F.lit(f"{side}_{check}").alias("check"), value.alias("value"), threshold.alias("threshold"), alert.alias("alert"), status.alias("status"))

    numeric = kind[F.col("feature")] == "numeric"
    found = [
        row("missing_fraction", missing, allowed, exceeds_column(missing, allowed), F.when(nullable[F.col("feature")], "warning").otherwise("critical")),
        F.when(numeric, row("infinite_count", infinite, F.lit(0.0), infinite > 0, F.lit("critical"))),
    ]
    for key, value, beyond in (("min", "least", "below_min"), ("max", "largest", "above_max")):
        bound = bounds[key][F.col("feature")]
        alert = F.when(F.col(value).isNotNull(), F.col(beyond) > 0)
        found.append(F.when(numeric & bound.isNotNull(), row(key, F.col(value), bound, alert, F.lit("critical"))))
    return profiled.select("feature", F.explode(F.array(*found)).alias("x")).where(F.col("x").isNotNull()).select("feature", "x.*")
