"""tidemark: data-quality control and distribution-drift monitoring on Spark DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

__version__ = "0.1.0"


def analyze(reference: Any, current: Any, config: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Compare two DataFrames: see tidemark.plans.analysis.analyze."""
    from .plans.analysis import analyze as run

    return run(reference, current, config)


def changed_categories(reference: Any, current: Any, config: Mapping[str, Any] | None = None) -> Any:
    """Every new and disappeared category: see tidemark.plans.analysis.changed_categories."""
    from .plans.analysis import changed_categories as run

    return run(reference, current, config)
