"""Command line of the demonstration data: writes a reference and a current table, and what was done to them.

    python -m tidemark.sources --scenario combined --seed 7 --format both --output-dir data
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..cli import Parser
from .synth import SCENARIOS, generate, write


def parser() -> Parser:
    p = Parser(prog="python -m tidemark.sources", description="Make demonstration data with a chosen kind of drift.")
    p.add_argument("--scenario", choices=SCENARIOS, default="none")
    for name, kind, default in (("seed", int, 42), ("n-reference", int, 5000), ("n-current", int, 3000), ("age-shift-years", float, 8.0), ("reference-income-missing-fraction", float, 0.02), ("drifted-income-missing-fraction", float, 0.08)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--format", choices=("csv", "parquet", "both"), default="both")
    p.add_argument("--output-dir", default="data/generated")
    p.add_argument("--overwrite", action="store_true")
    return p


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    spark = spark or SparkSession.builder.appName("tidemark-data").getOrCreate()
    reference, current, about = generate(
        spark, seed=args.seed, n_reference=args.n_reference, n_current=args.n_current, scenario=args.scenario, age_shift=args.age_shift_years,
        reference_missing=args.reference_income_missing_fraction, drifted_missing=args.drifted_income_missing_fraction,
    )
    for k, kind in enumerate(("csv", "parquet") if args.format == "both" else (args.format,)):
        write(reference, current, about, args.output_dir, kind, args.overwrite or k > 0)
    print(f"scenario {args.scenario}, seed {args.seed}: {args.n_reference} and {args.n_current} rows in {args.output_dir}")
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        return run(parser().parse_args(argv), spark)
    except SystemExit as e:
        return int(e.code or 0)
    except Exception as e:  # noqa: BLE001  the command line's last resort
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
