"""An HTML page of one result: what it decided and on what grounds; small charts from aggregates.

The page stands alone: no scripts, no external files. It shows values of the result and computes none.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from html import escape
from typing import Any

from pyspark.sql import DataFrame

from .operators.cells import category_cells
from .operators.histogram import category_shares, equal_width
from .operators.longform import category_long, numeric_long
from .sources.tables import ready_to_write, write_text_atomic

STYLE = "body{font:15px/1.5 sans-serif;margin:2em auto;max-width:70em;padding:0 1em;color:#222}table{border-collapse:collapse;margin:.5em 0 1.5em}td,th{border:1px solid #ccc;padding:.25em .6em;text-align:left;vertical-align:top}.ok{color:#176b34}.warning{color:#8a5a00}.critical,.error{color:#a3131a}.skipped{color:#666}rect.r{fill:#4269a8}rect.c{fill:#d08a2e}"
CATEGORIES = 20


def value_text(x: Any) -> str:
    return "-" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else str(x)


def badge(status: str) -> str:
    return f'<b class="{escape(status)}">{escape(status)}</b>'


def table(header: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """Cells are HTML already."""
    head = "".join(f"<th>{escape(h)}</th>" for h in header)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(f'<td>{c}</td>' for c in r) + '</tr>' for r in rows)}</table>" if rows else "<p>none</p>"


def check_row(name: str, check: Mapping[str, Any]) -> list[str]:
    numbers = [escape(value_text(check[k])) for k in ("value", "threshold", "p_value", "adjusted_p_value", "alert")]
    return [escape(name), escape(check["name"]), badge(check["status"]), *numbers, escape(check["reason"] or "")]


CHECK_HEAD = ("feature", "check", "status", "value", "threshold", "p-value", "adjusted", "alert", "reason")


def labels(categories: Sequence[str]) -> list[str]:
    """Categories without their type, which comes back where two would look alike."""
    short = [c.split(":", 1)[-1] for c in categories]
    return [s if short.count(s) == 1 else c for s, c in zip(short, categories, strict=True)]


def bars(pairs: Sequence[tuple[str, float, float]]) -> str:
    """A pair of bars for each label."""
    top = max([x for _, *p in pairs for x in p] or [0]) or 1
    wide = max(12, 640 // max(1, len(pairs)))
    out = []
    for k, (label, r, c) in enumerate(pairs):
        for j, (x, kind) in enumerate(((r, "r"), (c, "c"))):
            h = 120 * x / top
            out.append(f'<rect class="{kind}" x="{k * wide + j * wide * 0.42:.1f}" y="{120 - h:.1f}" width="{wide * 0.4:.1f}" height="{h:.1f}"><title>{escape(label)}: {x:.4g}</title></rect>')
    return f'<svg width="{wide * len(pairs)}" height="122" role="img">{"".join(out)}</svg>'


def charts(result: Mapping[str, Any], reference: DataFrame, current: DataFrame) -> str:
    out = []
    for name, f in result["drift"]["features"].items():
        if name not in result["schema"]["valid_features"]:
            continue
        if f["feature_type"] == "numeric":
            rows = equal_width(numeric_long(reference, current, [name]), name).collect()  # MOST_BINS a side
            by = {(r["side"], r["bin"]): r for r in rows}
            bins = sorted({r["bin"] for r in rows})
            share = lambda s, b: by[s, b]["fraction"] or 0.0  # noqa: E731,B023
            pairs = [(f"{by['reference', b]['left']:.6g} to {by['reference', b]['right']:.6g}", share("reference", b), share("current", b)) for b in bins]
        else:
            frame = category_shares(category_cells(category_long(reference, current, [name])))
            rows = frame.where(f"place <= {CATEGORIES}").orderBy("place").collect()
            pairs = [(n, r["p_reference"] or 0.0, r["p_current"] or 0.0) for n, r in zip(labels([r["cell"] for r in rows]), rows, strict=True)]
        out.append(f"<h3>{escape(name)}</h3>{bars(pairs) if pairs else '<p>no values</p>'}")
    return "".join(out)


def html(result: Mapping[str, Any], reference: DataFrame | None = None, current: DataFrame | None = None) -> str:
    for key in ("summary", "alerts", "schema", "quality", "drift", "adversarial", "effective_config"):
        if key not in result:
            raise ValueError(f"this is no result of analyze: {key} is missing")
    s, q, d, a = result["summary"], result["quality"], result["drift"], result["adversarial"]
    quality = [check_row("", c) for c in q["dataset_checks"]] + [check_row(n, c) for n, cs in q["feature_checks"].items() for c in cs]
    drift = [check_row(n, c) for n, f in d["features"].items() for c in f["checks"].values()]
    categories = [[escape(n), *(escape(value_text(c["details"].get(k))) for k in ("original_category_count", "new_category_count", "disappeared_category_count", "pooled_category_count", "cramers_v"))] for n, f in d["features"].items() if (c := f["checks"].get("chi2"))]
    schema = [[escape(k), escape(side), escape(", ".join(result["schema"][k][side]))] for k in ("missing_columns", "extra_columns", "duplicate_columns") for side in ("reference", "current") if result["schema"][k][side]]
    schema += [["type_mismatches", escape(m["dataset"]), escape(f"{m['column']}: {m['actual']}, not {m['expected']}")] for m in result["schema"]["type_mismatches"]]
    importance = [[escape(n), f"{x:.4f}"] for n, x in a["feature_importance"].items()]
    parts = [
        f"<h1>Data quality and drift: {badge(s['status'])}</h1>",
        table(list(result["metadata"]), [[escape(value_text(v)) for v in result["metadata"].values()]]),
        table(list(s), [[escape(value_text(v)) for v in s.values()]]),
        "<h2>Alerts</h2>", table(("source", "feature", "check", "severity", "message"), [[escape(value_text(x[k])) for k in ("source", "feature", "check", "severity", "message")] for x in result["alerts"]]),
        f"<h2>Schema {badge(result['schema']['status'])}</h2>", table(("problem", "table", "columns"), schema),
        f"<h2>Quality {badge(q['status'])}</h2>", table(CHECK_HEAD, quality),
        f"<h2>Drift {badge(d['status'])}</h2>", table(CHECK_HEAD, drift),
        table(("feature", "categories", "new", "gone", "pooled", "Cramer's V"), categories),
        f"<h2>Adversarial validation {badge(a['status'])}</h2>", table(("ROC-AUC", "threshold", "folds", "alert", "reason"), [[escape(value_text(a["roc_auc"])), escape(value_text(a["threshold"])), escape(", ".join(map(value_text, a["fold_auc"]))), escape(value_text(a["alert"])), escape(a["reason"] or "")]]), table(("feature", "importance"), importance) if importance else "",
        f"<h2>Distributions</h2>{charts(result, reference, current)}" if reference is not None and current is not None else "",
        f"<h2>Configuration</h2><pre>{escape(json.dumps(result['effective_config'], indent=2, ensure_ascii=False))}</pre>",
    ]
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Data quality and drift</title><style>{STYLE}</style></head><body>{"".join(parts)}</body></html>'


def export_html(result: Mapping[str, Any], path: str | os.PathLike[str], reference: DataFrame | None = None, current: DataFrame | None = None, overwrite: bool = False) -> None:
    ready_to_write(path, overwrite)
    write_text_atomic(path, html(result, reference, current), overwrite)
