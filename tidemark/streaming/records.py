"""Monitoring's tables as frames: latest versions, states, pages, oldest records, keys, and the overview of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The last version of every record."""
    names = versions.columns
    return versions.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*names), version).alias("x")).select("x.*")


def counts_by(records: DataFrame, field: str) -> DataFrame:
    """(field, n): how many records are in each state."""
    return records.groupBy(field).agg(F.count("*").alias("n"))


def claimed(events: DataFrame) -> DataFrame:
    """(window_id, first_sequence) of the windows that are claimed and not finished."""
    return events.where("state = 'claimed'").groupBy("window_id").agg(F.min("sequence").alias("first_sequence"))


def oldest(events: DataFrame, state: str, n: int, order: str = "sequence", key: str = "event_id") -> DataFrame:
    """The first n events in a state: each partition keeps n, and those are merged."""
    return events.where(F.col("state") == state).orderBy(order, key).limit(n)


def page(runs: DataFrame, limit: int, offset: int = 0, status: str | None = None) -> DataFrame:
    """Runs, latest first."""
    runs = runs.where(F.col("status") == status) if status else runs
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).offset(offset).limit(limit)


def with_known(rows: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Adds `known`: whether records hold the row's key."""
    held = records.select(F.col(key).alias("_key")).distinct()
    return rows.join(held, F.col(key) == F.col("_key"), "left").withColumn("known", F.col("_key").isNotNull()).drop("_key")


def overview(runs: DataFrame, deliveries: DataFrame, measured: DataFrame) -> DataFrame:
    """A row per run with its alert count, deliveries by state, and performance."""
    sent = deliveries.groupBy("run_id").agg(F.count(F.when(F.col("status") == "succeeded", 1)).alias("delivered"), F.count(F.when(F.col("status") == "failed", 1)).alias("undelivered"))
    performance = measured.select("run_id", F.col("status").alias("performance_status"), "metrics")
    summary = F.from_json(F.get_json_object("result", "$.summary"), "status string, n_alerts long")
    joined = runs.withColumn("summary", summary).drop("result").join(sent, "run_id", "left").join(performance, "run_id", "left")
    return joined.select("*", "summary.n_alerts", F.col("summary.status").alias("result_status")).drop("summary")
