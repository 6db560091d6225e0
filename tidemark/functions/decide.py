"""Threshold comparisons that treat values equal to the threshold, up to rounding, as not beyond it."""

from __future__ import annotations

from math import isclose

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def exceeds(value: float, threshold: float) -> bool:
    return value > threshold and not isclose(value, threshold, rel_tol=TOLERANCE, abs_tol=TOLERANCE)


def falls_below(value: float, threshold: float) -> bool:
    return value < threshold and not isclose(value, threshold, rel_tol=TOLERANCE, abs_tol=TOLERANCE)


def _close(value: Column, threshold: Column) -> Column:
    scale = F.greatest(F.abs(value), F.abs(threshold)) * TOLERANCE
    return F.abs(value - threshold) <= F.greatest(scale, F.lit(TOLERANCE))


def exceeds_column(value: Column, threshold: Column) -> Column:
    """Null where either is null: no decision."""
    return (value > threshold) & ~_close(value, threshold)


def falls_below_column(value: Column, threshold: Column) -> Column:
    return (value < threshold) & ~_close(value, threshold)
