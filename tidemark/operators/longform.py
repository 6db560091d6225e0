"""Reference and current as one long frame, so that one job serves all features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import as_double, category_key, is_finite


def _values(frame: DataFrame, columns: dict, value: str, by: str | None) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias("feature"), c.alias(value)) for name, c in columns.items()]
    kept = [by] if by else []
    return frame.select(*kept, F.explode(F.array(*pairs)).alias("_x")).select(*kept, "_x.feature", f"_x.{value}")


def numeric_values(frame: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """(by, feature, v): the finite values of numeric features; -0.0 is 0.0."""
    return _values(frame, {n: as_double(n) for n in features}, "v", by).where(is_finite(F.col("v"))).withColumn("v", F.col("v") + F.lit(0.0))


def category_values(frame: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """(by, feature, category): the values that are there, with their type."""
    return _values(frame, {n: category_key(n) for n in features}, "category", by).where(F.col("category").isNotNull())


def _both(sides: tuple[DataFrame, DataFrame]) -> DataFrame:
    marked = [f.select("feature", F.lit(side).alias("is_reference"), f.columns[-1]) for f, side in zip(sides, (True, False), strict=True)]
    return marked[0].unionByName(marked[1])


def numeric_long(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, is_reference, v): the finite values of numeric features."""
    return _both((numeric_values(reference, features), numeric_values(current, features)))


def category_long(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, is_reference, category): the values that are there, with their type."""
    return _both((category_values(reference, features), category_values(current, features)))
