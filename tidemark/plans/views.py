"""Views of results as DataFrames: one row per check, filtered, projected, with names for values."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKS = "position int, section string, feature string, check string, status string, value double, threshold double, p_value double, adjusted_p_value double, alert boolean, reason string, details string"
ALERTS = "position int, source string, feature string, check string, severity string, message string"


def _number(x: Any) -> float | None:
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None


def checks_frame(spark: SparkSession, result: Mapping[str, Any]) -> DataFrame:
    """Every check of a result in its order; details as JSON text."""
    found = [("quality", None, c) for c in result["quality"]["dataset_checks"]]
    found += [("quality", n, c) for n, cs in result["quality"]["feature_checks"].items() for c in cs]
    found += [("drift", n, c) for n, f in result["drift"]["features"].items() for c in f["checks"].values()]
    rows = [
        (k, section, feature, c["name"], c["status"], *(_number(c[x]) for x in ("value", "threshold", "p_value", "adjusted_p_value")), c["alert"], c["reason"], json.dumps(c["details"], sort_keys=True))
        for k, (section, feature, c) in enumerate(found)
    ]
    return spark.createDataFrame(rows, CHECKS)


def alerts_frame(spark: SparkSession, result: Mapping[str, Any]) -> DataFrame:
    """Alerts in their order: schema, quality, drift, adversarial."""
    return spark.createDataFrame([(k, *(a[x] for x in ("source", "feature", "check", "severity", "message"))) for k, a in enumerate(result["alerts"])], ALERTS)


def visible(checks: DataFrame, statuses: Sequence[str] = (), features: Sequence[str] = ()) -> DataFrame:
    """Rows of the statuses and features given (none: all), without the columns that are empty in all of them."""
    rows = checks
    for column, chosen in (("status", statuses), ("feature", features)):
        rows = rows.where(F.col(column).isin(list(chosen))) if chosen else rows
    filled = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).first()
    return rows.select(*[c for c in rows.columns if filled[c]] or rows.columns)


def projected(rows: DataFrame, columns: Mapping[str, str], values: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Columns under new names, in order; `values` gives texts for some of a column's values."""
    out = []
    for column, name in columns.items():
        c, known = F.col(column), (values or {}).get(column)
        if known:
            c = F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[c.cast("string")], c.cast("string"))
        out.append(c.alias(name))
    return rows.select(*out)
