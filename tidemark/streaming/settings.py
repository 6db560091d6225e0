"""Configuration of monitoring: the analysis's keys, and `online` beside them."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from typing import Any

from ..config import boolean, keys, mapping, nullable, number, one_of, section, text, validate_config, whole, within

ANALYSIS_KEYS = ("contract_version", "random_seed", "schema", "quality", "drift", "adversarial")


def _positive(value: Any, path: str) -> float:
    x = number(value, path)
    if x <= 0:
        raise ValueError(f"{path} must be positive")
    return x


def _variable(value: Any, path: str) -> str:
    if not isinstance(value, str) or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", value):
        raise ValueError(f"{path} must be the name of an environment variable")
    return value


def _window(value: Any, path: str) -> dict[str, Any]:
    w = section(value, path, {"strategy": one_of("tumbling"), "size": whole(2), "min_batch_rows": whole(2)})
    if w["min_batch_rows"] > w["size"]:
        raise ValueError(f"{path}.min_batch_rows must not be above size")
    return w


def _alerts(value: Any, path: str) -> dict[str, Any]:
    return section(value, path, {"jsonl_path": nullable(text), "webhook_url_env": nullable(_variable), "timeout_seconds": _positive, "max_attempts": whole(1)})


def _performance(value: Any, path: str) -> dict[str, Any]:
    fraction = nullable(within(0.0, 1.0))
    p = section(value, path, {"enabled": boolean, "min_feedback_rows": whole(2), "baseline_accuracy": fraction, "max_accuracy_drop": fraction, "baseline_roc_auc": fraction, "max_roc_auc_drop": fraction})
    for metric in ("accuracy", "roc_auc"):
        if (p[f"baseline_{metric}"] is None) != (p[f"max_{metric}_drop"] is None):
            raise ValueError(f"{path}: baseline_{metric} and max_{metric}_drop are set together or not at all")
    return p


def _online(value: Any, path: str = "online") -> dict[str, Any]:
    return section(value, path, {"state_path": text, "window": _window, "alerts": _alerts, "performance": _performance, "max_body_mb": within(0.0, math.inf, open_ends=True)})


def validate_monitoring_config(value: Any) -> dict[str, Any]:
    """{analysis, online}, from that form or from the analysis's keys with `online` among them."""
    root = mapping(value, "config")
    if set(root) == {"analysis", "online"}:
        analysis = root["analysis"]
    else:
        keys(root, "config", {*ANALYSIS_KEYS, "online"})
        analysis = {k: root[k] for k in ANALYSIS_KEYS}
    online = _online(root["online"])
    if online["alerts"]["jsonl_path"] == online["state_path"]:
        raise ValueError("online.alerts.jsonl_path and online.state_path must differ")
    return {"analysis": validate_config(analysis), "online": online}


def default_online(state_path: str, size: int = 500, min_batch_rows: int = 100) -> dict[str, Any]:
    return _online(
        {
            "state_path": state_path,
            "window": {"strategy": "tumbling", "size": size, "min_batch_rows": min_batch_rows},
            "alerts": {"jsonl_path": None, "webhook_url_env": None, "timeout_seconds": 5.0, "max_attempts": 3},
            "performance": {"enabled": False, "min_feedback_rows": 100, "baseline_accuracy": None, "max_accuracy_drop": None, "baseline_roc_auc": None, "max_roc_auc_drop": None},
            "max_body_mb": 25.0,
        }
    )


def merged(analysis: Mapping[str, Any], online: Mapping[str, Any]) -> dict[str, Any]:
    return validate_monitoring_config({"analysis": dict(analysis), "online": dict(online)})
