"""Row numbers in a global order, counted per range of the order, not in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def number_rows(frame: DataFrame, *order: Column | str, name: str = "n", start: int = 1) -> DataFrame:
    """Adds `name`: start, start + 1, ... in the order given, which should tell rows apart.

    Rows are cut into ranges; a row's number is its place in its range plus the sizes of those before.
    Both are read from one written table, so they agree.
    """
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", place))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + start).drop("_part", "_place", "_before")
