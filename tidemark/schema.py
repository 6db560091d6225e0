"""Schema validation: what columns are there, and whether their types serve. No job but for emptiness."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from .config import validate_schema_config
from .contracts import SIDES, alert_record
from .functions.canonical import kind_of


def require_frames(reference: object, current: object) -> None:
    bad = [f"{name} ({type(x).__name__})" for name, x in zip(SIDES, (reference, current), strict=True) if not isinstance(x, DataFrame)]
    if bad:
        raise TypeError(f"Spark DataFrames are needed: {', '.join(bad)}")


def is_empty(frame: DataFrame) -> bool:
    return not frame.columns or frame.isEmpty()


def validate_schema(reference: DataFrame, current: DataFrame, config: Mapping[str, Any], empty: Mapping[str, bool] | None = None) -> dict[str, Any]:
    """Missing, extra and repeated columns, unfit types, and the features that can be analysed.

    Types may differ between the sides, as long as both are of the declared kind. `empty` spares the
    job that finds out.
    """
    require_frames(reference, current)
    schema = validate_schema_config(config)
    features, frames = schema["features"], dict(zip(SIDES, (reference, current), strict=True))
    empty = {s: is_empty(f) for s, f in frames.items()} if empty is None else empty
    repeated = {s: [c for c, n in Counter(f.columns).items() if n > 1] for s, f in frames.items()}
    missing = {s: [n for n in features if n not in f.columns] for s, f in frames.items()}
    extra = {s: list(dict.fromkeys(c for c in f.columns if c not in features)) for s, f in frames.items()}
    mismatches = [
        {"column": f.name, "dataset": side, "expected": features[f.name]["kind"], "actual": f.dataType.simpleString()}
        for side, frame in frames.items()
        for f in sorted((f for f in frame.schema if f.name in features and f.name not in repeated[side]), key=lambda f: list(features).index(f.name))
        if kind_of(f.dataType) != features[f.name]["kind"]
    ]
    unfit = {m["column"] for m in mismatches}.union(*missing.values(), *repeated.values())
    empties = [s for s in SIDES if empty[s]]
    problems = []
    if empties:
        problems.append(f"empty tables: {', '.join(empties)}")
    for name, found, counts in (("missing columns", missing, True), ("extra columns", extra, not schema["allow_extra_columns"]), ("repeated column names", repeated, True)):
        n = sum(map(len, found.values()))
        if n and counts:
            problems.append(f"{name}: {n}")
    if mismatches:
        problems.append(f"unfit types: {len(mismatches)}")
    return {
        "status": "error" if problems else "ok",
        "missing_columns": missing,
        "extra_columns": extra,
        "duplicate_columns": repeated,
        "type_mismatches": mismatches,
        "valid_features": [] if empties else [n for n in features if n not in unfit],
        "reason": f"the schema is violated: {'; '.join(problems)}" if problems else None,
    }


def schema_alerts(result: Mapping[str, Any], config: Mapping[str, Any], empty: Mapping[str, bool]) -> list[dict[str, Any]]:
    out = []
    add = lambda feature, check, message: out.append(alert_record("schema", feature, check, "critical", message))
    for side in SIDES:
        if empty[side]:
            add(None, "empty_dataset", f"{side} is empty")
        for name in result["missing_columns"][side]:
            add(name, "missing_column", f"column {name!r} is missing in {side}")
        if not config["allow_extra_columns"]:
            for name in result["extra_columns"][side]:
                add(name, "extra_column", f"column {name!r} of {side} is not in the schema")
        for name in result["duplicate_columns"][side]:
            add(name, "duplicate_column", f"column name {name!r} occurs more than once in {side}")
    for m in result["type_mismatches"]:
        add(m["column"], "type_mismatch", f"type {m['actual']} of {m['column']!r} in {m['dataset']} is not {m['expected']}")
    return out


def skip_reason(feature: str, result: Mapping[str, Any]) -> str:
    why = []
    for side in SIDES:
        if feature in result["missing_columns"][side]:
            why.append(f"missing in {side}")
        if feature in result["duplicate_columns"][side]:
            why.append(f"its name occurs more than once in {side}")
    why += [f"type {m['actual']} in {m['dataset']} is not {m['expected']}" for m in result["type_mismatches"] if m["column"] == feature]
    return f"feature {feature!r} is skipped: {'; '.join(why) or 'not available after schema validation'}"
