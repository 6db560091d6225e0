"""Population stability index and Jensen-Shannon divergence, of cells and of plain vectors."""

from __future__ import annotations

import math
from numbers import Real

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import check_result

SMOOTHING = 1e-6
BASE = 2.0


def psi_js(cells: DataFrame, smoothing: float = SMOOTHING, base: float = BASE) -> DataFrame:
    """(feature, n_cells, psi, js) from numeric_cells or category_cells."""
    k = cells.groupBy("feature").agg(F.count("*").alias("n_cells"))
    smooth = lambda p: (F.col(p) + smoothing) / (1 + smoothing * F.col("n_cells"))
    p, q = smooth("p_reference"), smooth("p_current")
    middle = (F.col("p_reference") + F.col("p_current")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / middle)).otherwise(F.when(F.col(x).isNotNull(), 0.0))
    sums = cells.join(F.broadcast(k), "feature").groupBy("feature", "n_cells").agg(
        F.sum((q - p) * F.log(q / p)).alias("psi"), (F.sum(part("p_reference") + part("p_current")) / (2 * math.log(base))).alias("js")
    )
    no_less = lambda x: F.when((F.col(x) < 0) & (F.col(x) > -1e-15), 0.0).otherwise(F.col(x)).alias(x)
    return sums.select("feature", "n_cells", no_less("psi"), no_less("js"))


def _number(name: str, value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, Real) or not math.isfinite(float(value)):
        raise ValueError(f"{name} must be a finite number")
    return float(value)


def _vectors(name: str, reference: list[float], current: list[float]) -> tuple[list[float], list[float]] | dict:
    """Both vectors as probabilities, or the result that says why there are none."""
    if len(reference) != len(current):
        return check_result(name, "error", reason="the vectors differ in length")
    if not reference:
        return check_result(name, "skipped", reason="the vectors are empty")
    out = []
    for side, vector in (("reference", reference), ("current", current)):
        if any(isinstance(x, bool) or not isinstance(x, Real) for x in vector):
            return check_result(name, "error", reason=f"{side} holds something that is not a real number")
        if any(not math.isfinite(x) or x < 0 for x in vector):
            return check_result(name, "error", reason=f"{side} holds a negative or non-finite value")
        top = max(vector)
        if top == 0:
            return check_result(name, "skipped", reason=f"{side} sums to zero")
        scaled = [float(x) / top for x in vector]  # first by the largest, so that the sum stays finite
        total = math.fsum(scaled)
        out.append([x / total for x in scaled])
    return out[0], out[1]


def psi(reference: list[float], current: list[float], smoothing: float = SMOOTHING) -> dict:
    smoothing = _number("smoothing", smoothing)
    if not 0 < smoothing < 1 or smoothing < 2.2250738585072014e-308:
        raise ValueError("smoothing must lie between 0 and 1")
    found = _vectors("psi", reference, current)
    if isinstance(found, dict):
        return found
    p, q = ([(x + smoothing) / (1 + smoothing * len(v)) for x in v] for v in found)
    value = math.fsum((b - a) * math.log(b / a) for a, b in zip(p, q, strict=True))
    return check_result("psi", "ok", value=0.0 if -1e-15 < value < 0 else value, details={"smoothing": smoothing, "n_cells": len(p)})


def js_divergence(reference: list[float], current: list[float], base: float = BASE) -> dict:
    base = _number("base", base)
    if base <= 0 or base == 1:
        raise ValueError("base must be positive and not 1")
    found = _vectors("js", reference, current)
    if isinstance(found, dict):
        return found
    terms = []
    for a, b in zip(*found, strict=True):
        m = (a + b) / 2
        terms += [x * math.log(x / m) for x in (a, b) if x > 0]
    value = math.fsum(terms) / 2 / math.log(base)
    return check_result("js", "ok", value=0.0 if -1e-15 < value < 0 else value, details={"base": base, "n_cells": len(found[0])})
