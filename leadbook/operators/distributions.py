"""One-dimensional distributions, all fields of a report in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadbook.functions.counting import leads
from leadbook.functions.text import clean

MAX_SLICES = 8  # chart slots; beyond them the tail is folded into `Other`


def field_counts(df: DataFrame, fields: dict[str, Column], counted: str | None = None) -> DataFrame:
    """(field, value, count) of the cleaned values, nulls left out.

    Every row feeds one aggregate whatever the number of fields, and repeated
    values are combined before the shuffle, so a value held by a third of the
    rows moves as one row per task.  `counted` names a column of counts, where a row
    stands for several leads.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), clean(c).alias("value")) for f, c in fields.items()]))
    weight = [counted] if counted else []
    long = df.select(*weight, cells.alias("cell")).select(*weight, "cell.field", "cell.value")
    return long.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(leads(counted=counted).alias("count"))


def _field_totals(counts: DataFrame) -> DataFrame:
    # One row per charted field, a list fixed in the code: safe to broadcast.
    return F.broadcast(
        counts.groupBy("field").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("categories"))
    )


def distribution(counts: DataFrame, top: int | None = None) -> DataFrame:
    """Values with count and share, most frequent first, per field.

    With `top` only that many values of each field are kept; the limit is applied
    inside every task before rows are shuffled.  Shares stay shares of all values.
    """
    shared = counts.join(_field_totals(counts), "field").withColumn(
        "share", F.round(F.col("count") / F.col("total"), 4)
    )
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
        shared = shared.withColumn("__rank", rank).filter(F.col("__rank") <= top)
    return shared.select("field", "value", "count", "share").orderBy("field", F.desc("count"), "value")


def value_counts(df: DataFrame, column: Column, top: int | None = None) -> DataFrame:
    """The distribution of one column."""
    return distribution(field_counts(df, {"field": column}), top).drop("field")


def fold_slices(counts: DataFrame, slots: int = MAX_SLICES) -> DataFrame:
    """Chart slices: all values if they fit, else the largest and `Other`.

    The folded count is the field's total less the kept values, so the tail is
    never gathered anywhere.
    """
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
    ranked = counts.withColumn("position", rank).filter(F.col("position") <= slots)
    totals = _field_totals(counts)
    head = ranked.join(totals, "field").filter(
        (F.col("categories") <= slots) | (F.col("position") < slots)
    )
    kept = head.select("field", F.col("value").alias("label"), "count", "position", F.lit(0).cast("long").alias("folded"))
    other = (
        head.filter(F.col("categories") > slots)
        .groupBy("field", "total", "categories").agg(F.sum("count").alias("kept"))
        .select(
            "field",
            F.lit("Other").alias("label"),
            (F.col("total") - F.col("kept")).alias("count"),
            F.lit(slots).alias("position"),
            (F.col("categories") - slots + 1).alias("folded"),
        )
    )
    return kept.unionByName(other).orderBy("field", "position")
