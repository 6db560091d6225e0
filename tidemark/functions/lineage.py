"""Cutting a plan where later steps must see the very same rows, also after executors were lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset, a folder of this machine serves if all of Spark runs on it; a cluster needs the setting.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once, written as a table to the shared folder and read from there."""
    path = f"{shared_folder(frame.sparkSession)}/tidemark-cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
