"""Running sums in the order of a value, without a task that holds all values of a large group.

Groups of up to GROUP_ROWS distinct values are summed by a plain window. Beyond, all values are cut into
ranges, as many as their number asks for; sums run inside the ranges, and what lies in the ranges before
comes from a table of one row per range and group. Both ways give the same sums.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Distinct values of a group that one task sums.
GROUP_ROWS = 1_000_000


def running_sums(frame: DataFrame, group: str, order: str, sums: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """frame, distinct by (group, order), with `{s}_upto` (own row included), and the next `order` of the group."""
    frame = cut(frame)  # read more than once from here on
    size = frame.groupBy(group).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    following = lambda name: f"next_{name}"

    def upto(s: str, window: Column) -> Column:
        return F.sum(s).over(window.rowsBetween(Window.unboundedPreceding, 0))

    if (size["most"] or 0) <= group_rows:
        along = Window.partitionBy(group).orderBy(order)
        return frame.select("*", *[upto(s, along).alias(f"{s}_upto") for s in sums], F.lead(order).over(along).alias(following(order)))
    ranges = max(2, ceil(size["all"] / group_rows))
    placed = cut(frame.repartitionByRange(ranges, group, order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(group, "_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums], F.min(order).alias("_least"))
    along = Window.partitionBy(group).orderBy("_range")  # a row per range
    before = totals.select(
        F.col(group).alias("_group"), F.col("_range").alias("_own"), *[(F.sum(f"_{s}").over(along) - F.col(f"_{s}")).alias(f"_{s}") for s in sums], F.lead("_least").over(along).alias("_next")
    )
    inside = Window.partitionBy(group, "_range").orderBy(order)
    summed = placed.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_own")))
    return summed.select(
        *frame.columns,
        *[(F.col(f"_{s}") + upto(s, inside)).alias(f"{s}_upto") for s in sums],
        F.coalesce(F.lead(order).over(inside), F.col("_next")).alias(following(order)),
    )
