"""Command line: compare two tables, write the result. Exit 0: done; 1: an error; 2: alerts, if asked for."""

from __future__ import annotations

import argparse
import os
import sys
import traceback
from collections.abc import Sequence
from typing import Any, NoReturn

from pyspark.sql import SparkSession

from .plans.analysis import analyze
from .report import export_html
from .sources.tables import load_config, load_table, ready_to_write, write_json_atomic


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> NoReturn:
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: error: {message}\n")


def parser() -> Parser:
    p = Parser(prog="tidemark", description="Compare a current table with a reference one.")
    for name in ("reference", "current", "config", "json-output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--html-output")
    for flag in ("overwrite", "fail-on-alert", "debug"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def summary_lines(result: dict[str, Any]) -> list[str]:
    s, m = result["summary"], result["metadata"]
    return [
        f"status: {s['status']}", f"rows: reference {m['reference_rows']}, current {m['current_rows']}", f"features analysed: {s['analyzed_features']}", f"features skipped: {s['skipped_features']}", f"alerts: {s['n_alerts']}",
    ]


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    outputs = [args.json_output] + ([args.html_output] if args.html_output else [])
    if len({os.path.realpath(o) for o in outputs}) < len(outputs):
        raise ValueError("the JSON and the HTML output must be different files")
    for o in outputs:
        ready_to_write(o, args.overwrite)
    config = load_config(args.config)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    reference, current = load_table(spark, args.reference), load_table(spark, args.current)
    result = analyze(reference, current, config)
    write_json_atomic(args.json_output, result, args.overwrite)
    if args.html_output:
        export_html(result, args.html_output, reference, current, args.overwrite)
    print("\n".join(summary_lines(result) + [f"written: {o}" for o in outputs]))
    return 2 if args.fail_on_alert and result["summary"]["has_alerts"] else 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(args, spark)
    except Exception as e:  # noqa: BLE001  the command line's last resort
        if args.debug:
            traceback.print_exc()
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
