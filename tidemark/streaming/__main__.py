"""Command line of monitoring: streams JSON lines of events and labels from folders into a monitor's state.

    python -m tidemark.streaming --config online.yaml --events in/events --labels in/labels --checkpoint state/checkpoints --once

Spark's file source keeps track of what was read: a restart from the same checkpoint reads nothing twice. The
two streams have epochs of their own. Exit 0: done; 1: an error.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..cli import Parser
from ..sources.tables import load_monitoring_config
from .monitor import Monitor


def parser() -> Parser:
    p = Parser(prog="python -m tidemark.streaming", description="Monitor events and labels that come as files of JSON lines.")
    p.add_argument("--config", required=True, help="YAML with the configuration of analysis and monitoring")
    p.add_argument("--state", help="in place of the state's path in the configuration")
    p.add_argument("--reference", help="a table to register as a reference, and to activate if it is the first")
    p.add_argument("--name", help="the reference's name; its path, if not given")
    p.add_argument("--events", help="folder of JSON lines of events")
    p.add_argument("--labels", help="folder of JSON lines of labels")
    p.add_argument("--checkpoint", help="folder for the streams' checkpoints")
    p.add_argument("--every", default="10 seconds", help="how often folders are looked into")
    p.add_argument("--once", action="store_true", help="stop when all that is there has been read")
    return p


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    if (args.events or args.labels) and not args.checkpoint:
        raise ValueError("streams need --checkpoint")
    config = load_monitoring_config(args.config)
    if args.state:
        config["online"]["state_path"] = args.state
    spark = spark or SparkSession.builder.appName("tidemark-monitoring").getOrCreate()
    monitor = Monitor(spark, config)
    if args.reference:
        print(f"reference: {monitor.register_reference(args.reference, args.name or args.reference)['reference_id']}")
    trigger = {"availableNow": True} if args.once else {"processingTime": args.every}
    streams = [start(spark.readStream.text(folder), f"{args.checkpoint}/{name}", **trigger) for name, folder, start in (("events", args.events, monitor.stream), ("labels", args.labels, monitor.stream_labels)) if folder]
    try:
        for s in streams:
            s.awaitTermination()
    finally:
        for s in streams:
            s.stop()
    print(json.dumps(monitor.status(), default=str))
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
