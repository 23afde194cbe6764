"""Ranks and joins that hold when one key has a third of all rows.

`ranked` numbers rows inside groups of any size without bringing a group to one task.
`spread_join` looks up one row per key; the few keys that hold a large share of the rows
are joined where the rows are, all others by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadbook.runtime import discard, stage

# A key is hot when it holds more than this share of the rows, so there are at most as many hot keys.
HOT_SHARE = 1_000
# The rows of a partition stand in the low bits of a monotonically increasing id.
_PART_BITS = 33


def ranked(rows: DataFrame, within: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """`rows`, staged, with their place from 0 among the rows that agree on `within`.

    Rows are dealt by ranges of (within, order), so a large group is cut by its
    order, and sorted inside each range.  A row's place follows from the first row of its
    group in the range and the group's rows in earlier ranges, which are counted in a
    table with one row per group and range.  The columns `within` must not be null;
    nulls of `order` come first, and rows that agree on everything stand in any order.
    """
    part, first, start = "__part", "__first", "__start"
    keys = [*within, *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = stage(sorted_rows.withColumn(part, F.shiftright("__at", _PART_BITS)), "placed")
    runs = placed.groupBy(*within, part).agg(F.min("__at").alias(first), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn(start, F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    out = placed.join(starts, [*within, part]).withColumn(rank, F.col(start) + F.col("__at") - F.col(first))
    numbered = stage(out.drop("__at", part, first, start), "ranked")
    discard(placed)
    return numbered


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: Column, total: int, how: str = "inner") -> DataFrame:
    """Join `rows` to `table`, which has at most one row per key and knows how many of the rows hold it.

    `weight` is that number, a column of `table`, and `total` the number of rows.  Keys
    with more than total / HOT_SHARE rows are at most HOT_SHARE, which is what is
    broadcast; the rows of other keys are shuffled.  `table` is read twice, so a derived one should be
    staged.  `how` is inner or left; null keys match nothing.
    """
    hot = weight > max(1, total // HOT_SHARE)
    mark = table.where(hot).select(*on).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(mark), on, "left")
    near = marked.where("__hot").drop("__hot").join(F.broadcast(table.where(hot)), on, how)
    far = marked.where("__hot IS NULL").drop("__hot").join(table.where(~F.coalesce(hot, F.lit(False))), on, how)
    return near.unionByName(far)
