"""Strict analysis configuration: every key is known, none is missing, every value has its type.

Version 0.1 is accepted and becomes 0.2, which adds feature_thresholds and group_column.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from .functions.canonical import kind_of

#: The configuration's version, keys, method names and limits below are the contract (fixed values).
VERSION = "0.2"
NUMERIC_METHODS = ("ks", "wasserstein", "psi", "js")
CATEGORICAL_METHODS = ("chi2", "psi", "js")
DISTANCES = ("wasserstein", "psi", "js")
Check = Callable[[Any, str], Any]


def mapping(value: Any, path: str) -> dict[str, Any]:
    if not isinstance(value, Mapping):
        raise ValueError(f"{path} must be a mapping")
    if any(not isinstance(k, str) for k in value):
        raise ValueError(f"keys of {path} must be text")
    return dict(value)


def keys(value: dict[str, Any], path: str, required: set[str], optional: set[str] = frozenset()) -> None:
    missing, unknown = sorted(required - set(value)), sorted(set(value) - required - set(optional))
    if missing or unknown:
        said = [f"missing keys: {', '.join(missing)}"] * bool(missing) + [f"unknown keys: {', '.join(unknown)}"] * bool(unknown)
        raise ValueError(f"{path}: {'; '.join(said)}")


def boolean(value: Any, path: str) -> bool:
    if type(value) is not bool:
        raise ValueError(f"{path} must be true or false")
    return value


def whole(least: int) -> Check:
    def check(value: Any, path: str) -> int:
        if type(value) is not int or value < least:
            raise ValueError(f"{path} must be a whole number of at least {least}")
        return value

    return check


def number(value: Any, path: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValueError(f"{path} must be a finite number")
    return float(value)


def within(low: float, high: float, open_ends: bool = False) -> Check:
    def check(value: Any, path: str) -> float:
        x = number(value, path)
        if not (low < x < high if open_ends else low <= x <= high):
            raise ValueError(f"{path} must lie in {'(' if open_ends else '['}{low:g}, {high:g}{')' if open_ends else ']'}")
        return x

    return check


def nullable(check: Check) -> Check:
    return lambda value, path: None if value is None else check(value, path)


def one_of(*choices: Any) -> Check:
    def check(value: Any, path: str) -> Any:
        if value not in choices or isinstance(value, bool):
            raise ValueError(f"{path} must be one of {', '.join(map(str, choices))}")
        return value

    return check


def text(value: Any, path: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{path} must be text that is not blank")
    return value


def unique_list(check: Check) -> Check:
    def checked(value: Any, path: str) -> list[Any]:
        if not isinstance(value, list | tuple):
            raise ValueError(f"{path} must be a list")
        found = [check(x, f"{path}[{k}]") for k, x in enumerate(value)]
        if len(set(found)) < len(found):
            raise ValueError(f"{path} must not repeat values")
        return found

    return checked


def section(value: Any, path: str, checks: Mapping[str, Check]) -> dict[str, Any]:
    """All keys of `checks`, each as its check returns it."""
    found = mapping(value, path)
    keys(found, path, set(checks))
    return {k: check(found[k], f"{path}.{k}") for k, check in checks.items()}


NOT_NEGATIVE = within(0.0, math.inf)
FRACTION = within(0.0, 1.0)


def _base(value: Any, path: str) -> float:
    x = number(value, path)
    if x <= 0 or x == 1:
        raise ValueError(f"{path} must be positive and not 1")
    return x


def validate_schema_config(value: Any) -> dict[str, Any]:
    schema = mapping(value, "schema")
    keys(schema, "schema", {"features", "allow_extra_columns"})
    features = {}
    for name, given in mapping(schema["features"], "schema.features").items():
        path = f"schema.features.{name}"
        text(name, path)
        spec = mapping(given, path)
        keys(spec, path, {"kind", "nullable"}, {"min", "max"})
        out: dict[str, Any] = {"kind": one_of("numeric", "categorical")(spec["kind"], f"{path}.kind"), "nullable": boolean(spec["nullable"], f"{path}.nullable")}
        for bound in ("min", "max"):
            if bound in spec:
                if out["kind"] != "numeric":
                    raise ValueError(f"{path}.{bound} is for numeric features")
                out[bound] = number(spec[bound], f"{path}.{bound}")
        if out.get("min", -math.inf) > out.get("max", math.inf):
            raise ValueError(f"{path}: min is above max")
        features[name] = out
    if not features:
        raise ValueError("schema.features must not be empty")
    return {"features": features, "allow_extra_columns": boolean(schema["allow_extra_columns"], "schema.allow_extra_columns")}


def _feature_thresholds(features: Mapping[str, Any]) -> Check:
    def check(value: Any, path: str) -> dict[str, Any]:
        out = {}
        for name, given in mapping(value, path).items():
            if name not in features:
                raise ValueError(f"{path}.{name} is no feature of the schema")
            own = mapping(given, f"{path}.{name}")
            keys(own, f"{path}.{name}", set(), set(DISTANCES))
            if "wasserstein" in own and features[name]["kind"] == "categorical":
                raise ValueError(f"{path}.{name}.wasserstein is for numeric features")
            out[name] = {k: nullable(NOT_NEGATIVE)(v, f"{path}.{name}.{k}") for k, v in own.items()}
        return out

    return check


def validate_config(value: Any) -> dict[str, Any]:
    """A complete, normalised copy; ValueError says which key is wrong."""
    root = mapping(value, "config")
    sections = {"contract_version", "random_seed", "schema", "quality", "drift", "adversarial"}
    keys(root, "config", sections)
    version = one_of("0.1", VERSION)(root["contract_version"], "contract_version")
    drift, adversarial = mapping(root["drift"], "drift"), mapping(root["adversarial"], "adversarial")
    if version == "0.1":
        for part, path, key, default in ((drift, "drift", "feature_thresholds", {}), (adversarial, "adversarial", "group_column", None)):
            if key in part:
                raise ValueError(f"{path}: unknown keys: {key}")
            part[key] = default
    schema = validate_schema_config(root["schema"])
    return {
        "contract_version": VERSION,
        "random_seed": whole(0)(root["random_seed"], "random_seed"),
        "schema": schema,
        "quality": section(root["quality"], "quality", {"max_missing_fraction": FRACTION, "max_missing_increase_pp": within(0.0, 100.0), "max_duplicate_fraction": FRACTION}),
        "drift": section(
            drift,
            "drift",
            {
                "numeric_methods": unique_list(one_of(*NUMERIC_METHODS)),
                "categorical_methods": unique_list(one_of(*CATEGORICAL_METHODS)),
                "alpha": within(0.0, 1.0, open_ends=True),
                "multiple_testing": one_of("none", "bh"),
                "n_bins": whole(2),
                "psi_smoothing": within(0.0, 1.0, open_ends=True),
                "js_base": _base,
                "distance_thresholds": lambda v, p: section(v, p, dict.fromkeys(DISTANCES, nullable(NOT_NEGATIVE))),
                "feature_thresholds": _feature_thresholds(schema["features"]),
            },
        ),
        "adversarial": section(
            adversarial,
            "adversarial",
            {
                "enabled": boolean,
                "n_splits": whole(2),
                "roc_auc_threshold": nullable(FRACTION),
                "exclude_columns": unique_list(text),
                "group_column": nullable(text),
            },
        ),
    }


def default_config(reference: DataFrame) -> dict[str, Any]:
    """What is analysed when nothing is configured: all columns of the reference, by their types."""
    if not reference.columns:
        raise ValueError("nothing to infer a configuration from: the reference has no columns")
    features: dict[str, Any] = {}
    for f in reference.schema:
        kind = "numeric" if kind_of(f.dataType) == "numeric" else "categorical"
        features.setdefault(f.name, {"kind": kind, "nullable": True})
    return {
        "contract_version": VERSION,
        "random_seed": 42,
        "schema": {"features": features, "allow_extra_columns": False},
        "quality": {"max_missing_fraction": 0.1, "max_missing_increase_pp": 5.0, "max_duplicate_fraction": 0.01},
        "drift": {
            "numeric_methods": list(NUMERIC_METHODS), "categorical_methods": list(CATEGORICAL_METHODS), "alpha": 0.05, "multiple_testing": "bh", "n_bins": 10,
            "psi_smoothing": 1e-6, "js_base": 2.0, "distance_thresholds": dict.fromkeys(DISTANCES), "feature_thresholds": {},
        },
        "adversarial": {"enabled": False, "n_splits": 3, "roc_auc_threshold": None, "exclude_columns": [], "group_column": None},
    }


def with_overrides(config: Mapping[str, Any], *, adversarial_enabled: bool | None = None, roc_auc_threshold: float | None = None) -> dict[str, Any]:
    """A validated copy with adversarial settings changed for one run."""
    out = copy.deepcopy(dict(config))
    if adversarial_enabled is not None:
        out["adversarial"]["enabled"] = adversarial_enabled
    if roc_auc_threshold is not None:
        out["adversarial"]["roc_auc_threshold"] = roc_auc_threshold
    return validate_config(out)
