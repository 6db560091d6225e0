"""Statuses, result records and the rules that combine them."""

from __future__ import annotations

from typing import Any

STATUSES = ("error", "critical", "warning", "ok", "skipped")
SIDES = ("reference", "current")


def highest_status(statuses: list[str]) -> str:
    """error > critical > warning > ok > skipped; skipped for none."""
    return min(statuses, key=STATUSES.index, default="skipped")


def any_alert(alerts: list[bool | None]) -> bool | None:
    """Three-valued: True beats False beats no decision."""
    return True if True in alerts else False if False in alerts else None


def check_result(name: str, status: str, *, value: float | None = None, threshold: float | None = None, p_value: float | None = None, alert: bool | None = None, reason: str | None = None, details: dict[str, Any] | None = None) -> dict[str, Any]:
    return {
        "name": name, "status": status, "value": value, "threshold": threshold, "p_value": p_value,
        "adjusted_p_value": None, "alert": alert, "reason": reason, "details": details or {},
    }


def alert_record(source: str, feature: str | None, check: str, severity: str, message: str) -> dict[str, Any]:
    return {"source": source, "feature": feature, "check": check, "severity": severity, "message": message}
