"""Demonstration data: pairs of a reference and a current table with chosen kinds of drift, made by Spark.

Values depend on the seed and the row's number only, not on partitions. Missing values are exactly as
many as the fraction says: those rows whose hash ranks first. All batches that are asked for are made by one
plan, in chunks of rows, so neither many batches nor a large one is a loop or a task by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows

#: Regions and their shares, and those after drift (fixed values of the demonstration data).
REGIONS = ("central", "northwest", "south", "volga", "siberia")
SHARES = (0.30, 0.15, 0.20, 0.20, 0.15)
DRIFTED_SHARES = (0.55, 0.10, 0.10, 0.15, 0.10)
#: Mean, deviation, least and most of age, and of the logarithm of income (fixed values of the demonstration data).
AGE, INCOME = (42.0, 12.0, 18.0, 100.0), (math.log(85_000), 0.55, 0.0, 1e6)
#: Rows that are made together.
CHUNK = 10_000


@dataclass(frozen=True)
class Batch:
    """Rows to be made under a name: how many, from which seed, and how they are distributed."""

    name: str
    seed: int
    rows: int
    shares: tuple[float, ...] = SHARES
    missing: float = 0.02
    shift: float = 0.0


@dataclass(frozen=True)
class Drift:
    """A kind of drift: the feature it is of, what it makes of a batch, and what it reports of both batches."""

    feature: str
    change: Callable[[Batch, dict[str, float]], Batch]
    report: Callable[[Batch, Batch], dict[str, Any]]


def _shares(of: Batch) -> dict[str, float]:
    return dict(zip(REGIONS, of.shares, strict=True))


#: Names of scenarios and of what is reported are the contract (fixed values).
DRIFTS = {
    "numeric": Drift("age", lambda b, by: replace(b, shift=by["age_shift"]), lambda r, c: {"shift_years": c.shift}),
    "categorical": Drift("region", lambda b, by: replace(b, shares=DRIFTED_SHARES), lambda r, c: {"reference_shares": _shares(r), "current_shares": _shares(c)}),
    "missingness": Drift("income", lambda b, by: replace(b, missing=by["drifted_missing"]), lambda r, c: {"reference_fraction": r.missing, "current_fraction": c.missing}),
}
SCENARIOS = ("none", *DRIFTS, "combined")


def _uniform(stream: int) -> Column:
    """Numbers in (0, 1) from a hash of seed, stream and row number."""
    return (F.shiftrightunsigned(F.xxhash64("seed", F.lit(stream), "id"), 11).cast("double") + 0.5) / float(1 << 53)


def _normal(stream: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(stream))) * F.cos(2 * math.pi * _uniform(stream + 1))


def _within(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def _region(stream: int) -> Column:
    """The region whose range of shares a uniform number falls in."""
    out = F.lit(REGIONS[-1])
    for k in range(len(REGIONS) - 2, -1, -1):
        out = F.when(_uniform(stream) < F.col("upto")[k], REGIONS[k]).otherwise(out)
    return out


def batches(spark: SparkSession, wanted: Sequence[Batch], name: str = "batch") -> DataFrame:
    """The rows of all batches: their name, age, income, region."""
    totals = [[math.fsum(b.shares[: k + 1]) for k in range(len(REGIONS))] for b in wanted]
    asked = [(b.name, b.seed, b.rows, round(b.rows * b.missing), float(b.shift), t) for b, t in zip(wanted, totals, strict=True)]
    specs = spark.createDataFrame(asked, "own string, seed int, rows long, n_missing long, shift double, upto array<double>")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(CHUNK).cast("long")))
    chunks = specs.select("*", begins.alias("begin")).repartition(max(1, math.ceil(sum(b.rows for b in wanted) / (10 * CHUNK))))
    rows = chunks.select("*", F.explode(F.sequence("begin", F.least(F.col("begin") + CHUNK, "rows") - 1)).alias("id"))
    (mean, deviation, low, high), (mu, sigma, least, most) = AGE, INCOME
    age = _within(F.rint(_within(mean + deviation * _normal(1), low, high)) + F.col("shift"), low, high)
    income = F.round(_within(F.exp(mu + sigma * _normal(3)), least, most), 2)
    made = rows.select("own", "id", "n_missing", age.alias("age"), income.alias("income"), _region(5).alias("region"), _uniform(6).alias("u"))
    if any(round(b.rows * b.missing) for b in wanted):
        numbered = number_rows(made, "own", "u", "id", name="n")
        first = numbered.groupBy(F.col("own").alias("of")).agg(F.min("n").alias("first"))  # a row per batch
        made = numbered.join(first, F.col("own") == F.col("of")).withColumn("income", F.when(F.col("n") - F.col("first") >= F.col("n_missing"), F.col("income")))
    return made.select(F.col("own").alias(name), "age", "income", "region")


def planned(name: str, *, seed: int = 42, n_reference: int = 5000, n_current: int = 3000, scenario: str = "none", age_shift: float = 8.0, reference_missing: float = 0.02, drifted_missing: float = 0.08) -> tuple[Batch, Batch]:
    """The batches of a reference and a current table."""
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario must be one of {', '.join(SCENARIOS)}")
    if n_reference <= 0 or n_current <= 0:
        raise ValueError("row counts must be positive")
    if not all(0 <= f <= 1 for f in (reference_missing, drifted_missing)):
        raise ValueError("missing fractions must lie in [0, 1]")
    reference, current = Batch(name, 2 * seed, n_reference, missing=reference_missing), Batch(name, 2 * seed + 1, n_current, missing=reference_missing)
    for kind, drift in DRIFTS.items():
        if scenario in (kind, "combined"):
            current = drift.change(current, {"age_shift": age_shift, "drifted_missing": drifted_missing})
    return reference, current


def generate(spark: SparkSession, *, seed: int = 42, scenario: str = "none", **more: Any) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(reference, current, metadata); what may be given is what `planned` takes."""
    reference, current = planned("one", seed=seed, scenario=scenario, **more)
    applied = {kind: {"enabled": scenario in (kind, "combined"), "feature": drift.feature} | drift.report(reference, current) for kind, drift in DRIFTS.items()}
    about = {"scenario": scenario, "seed": seed, "n_reference": reference.rows, "n_current": current.rows, "applied_drift": applied}
    return batches(spark, [reference]).drop("batch"), batches(spark, [current]).drop("batch"), about


def write(reference: DataFrame, current: DataFrame, metadata: dict[str, Any], folder: str, file_format: str = "parquet", overwrite: bool = False) -> None:
    """reference and current under the folder, and metadata.json beside them."""
    from .tables import write_json_atomic

    if file_format not in ("csv", "parquet"):
        raise ValueError("the format must be csv or parquet")
    for name, frame in (("reference", reference), ("current", current)):
        writer = frame.write.mode("overwrite" if overwrite else "errorifexists")
        (writer.option("header", True).csv if file_format == "csv" else writer.parquet)(f"{folder}/{name}.{file_format}")
    write_json_atomic(f"{folder}/metadata.json", metadata, overwrite)
