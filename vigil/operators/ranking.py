"""Numbering rows within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_table


def numbered(df: DataFrame, group: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    """``df`` with the place (from 1) of each row in its group by ``order``, which should be total.

    The rows are sorted over ranges of (group, order), so one group runs over as many
    partitions as it needs, and numbered within their partition in one written table
    (partitions are then settled). A group's rows in a partition stand next to each
    other, so a place is the group's count in the partitions before, from a table of
    one row for each partition and group, and the distance from its first row there.
    """
    sort = [*map(F.col, group), *order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_place", F.monotonically_increasing_id())
    placed = checkpoint_table(df.sparkSession, placed.withColumn("_part", F.shiftright(F.col("_place"), 33)), "numbered")
    parts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    parts = parts.select(*group, "_part", "_first", before.alias("_before"))
    return placed.join(parts, [*group, "_part"]).withColumn(
        into, F.col("_before") + F.col("_place") - F.col("_first") + 1).drop("_place", "_part", "_first", "_before")
