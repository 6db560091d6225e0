"""Pearson's chi-square on category counts, with rare categories pooled; Cramer's V beside it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import POOLED

RARE_BELOW = 10
LEAST_OBSERVED = 5
LEAST_EXPECTED = 5.0


def check_parameters(rare_below: object = RARE_BELOW, least_observed: object = LEAST_OBSERVED, least_expected: object = LEAST_EXPECTED) -> None:
    for name, value in (("rare_below", rare_below), ("least_observed", least_observed)):
        if type(value) is not int or value < 1:
            raise ValueError(f"{name} must be a positive whole number")
    if isinstance(least_expected, bool) or not isinstance(least_expected, int | float) or not math.isfinite(least_expected) or least_expected <= 0:
        raise ValueError("least_expected must be a positive finite number")


def pooled(cells: DataFrame, rare_below: int = RARE_BELOW) -> DataFrame:
    """(feature, cell, n_reference, n_current): categories of fewer rows in all become one cell."""
    name = F.when(F.col("n_reference") + F.col("n_current") < rare_below, POOLED).otherwise(F.col("cell"))
    return cells.groupBy("feature", name.alias("cell")).agg(F.sum("n_reference").alias("n_reference"), F.sum("n_current").alias("n_current"))


def chi_square(cells: DataFrame, rare_below: int = RARE_BELOW, least_observed: int = LEAST_OBSERVED, least_expected: float = LEAST_EXPECTED) -> DataFrame:
    """A row per feature: n_cells, dof, chi2, cramers_v, least_observed, least_expected, and `applies`.

    chi2 and cramers_v are null where the test does not apply: fewer than two cells, or a cell with too
    small an observed or expected count.
    """
    check_parameters(rare_below, least_observed, least_expected)
    own = pooled(cells, rare_below)
    totals = own.groupBy("feature").agg(F.sum("n_reference").alias("r"), F.sum("n_current").alias("c"))
    both = own.join(F.broadcast(totals), "feature").withColumn("all", F.col("n_reference") + F.col("n_current"))
    expected = {side: F.try_divide(F.col("all") * F.col(total), F.col("r") + F.col("c")) for side, total in (("n_reference", "r"), ("n_current", "c"))}
    term = sum((F.coalesce(F.try_divide(F.pow(F.col(s) - e, F.lit(2)), e), F.lit(0.0)) for s, e in expected.items()), F.lit(0.0))
    out = both.groupBy("feature", "r", "c").agg(
        F.count("*").alias("n_cells"), F.sum(term).alias("x"), F.min(F.least("n_reference", "n_current")).alias("least_observed"), F.min(F.least(*expected.values())).alias("least_expected")
    )
    applies = (F.col("r") > 0) & (F.col("c") > 0) & (F.col("n_cells") >= 2) & (F.col("least_observed") >= least_observed) & (F.col("least_expected") >= least_expected)
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sqrt(F.col("x") / (F.col("r") + F.col("c")))))
    return out.select(
        "feature", F.col("r").alias("n_reference"), F.col("c").alias("n_current"), "n_cells", (F.col("n_cells") - 1).alias("dof"),
        F.when(applies, F.col("x")).alias("chi2"), F.when(applies, v).alias("cramers_v"), "least_observed", "least_expected", applies.alias("applies"),
    )


def category_changes(cells: DataFrame, rare_below: int = RARE_BELOW) -> DataFrame:
    """A row per feature: categories in all, new and gone ones, and what pooling takes in."""
    rare = (F.col("n_reference") + F.col("n_current")) < rare_below
    n = lambda c: F.count(F.when(c, 1))
    sums = cells.groupBy("feature").agg(
        F.count("*").alias("n_categories"), n(F.col("n_reference") == 0).alias("n_new"), n(F.col("n_current") == 0).alias("n_gone"), n(rare).alias("n_pooled"),
        *[F.coalesce(F.sum(F.when(rare, F.col(f"n_{s}"))), F.lit(0)).alias(f"pooled_{s}") for s in ("reference", "current")],
        *[F.sum(f"n_{s}").alias(f"t_{s}") for s in ("reference", "current")],
    )
    share = lambda a, b: F.when(b > 0, a / b)
    return sums.select(
        "feature", "n_categories", "n_new", "n_gone", "n_pooled",
        share(F.col("pooled_reference"), F.col("t_reference")).alias("pooled_fraction_reference"),
        share(F.col("pooled_current"), F.col("t_current")).alias("pooled_fraction_current"),
        share(F.col("pooled_reference") + F.col("pooled_current"), F.col("t_reference") + F.col("t_current")).alias("pooled_fraction"),
    )


def new_and_gone(cells: DataFrame) -> DataFrame:
    """(feature, cell, change): categories of one side only; change is new or disappeared."""
    change = F.when(F.col("n_reference") == 0, "new").when(F.col("n_current") == 0, "disappeared")
    return cells.select("feature", "cell", change.alias("change")).where(F.col("change").isNotNull())
