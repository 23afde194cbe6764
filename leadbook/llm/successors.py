"""Each document beside the next one by doc_id, with one shuffle and no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 64
MAX_RANGES = 65_536
_STEP = 256


def range_starts(ids: DataFrame, column: str, rows_per_range: int = ROWS_PER_RANGE) -> list[int]:
    """The smallest id of each of at most MAX_RANGES id ranges with about as many rows each.

    Approximate quantiles place the ranges; the starts are exact ids.  These are the
    only values that reach the driver.
    """
    known = ids.where(F.col(column).isNotNull())
    n = known.count()
    if not n:
        return []
    ranges = min(MAX_RANGES, max(1, n // rows_per_range))
    shares = [k / ranges for k in range(ranges)]
    guess = known.agg(F.percentile_approx(column, shares, 4 * ranges + 1000)).first()[0]
    lowest = known.agg(F.min(column)).first()[0]
    guess = sorted({lowest, *(g for g in guess if g > lowest)})
    firsts = known.groupBy(range_of(F.col(column), guess).alias("range")).agg(F.min(column).alias("first"))
    return sorted(r["first"] for r in firsts.collect())


def _constant(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def range_of(value: Column, starts: list[int]) -> Column:
    """The number of the range that holds `value`: a search in two steps over constant arrays."""
    coarse = F.size(F.filter(_constant(starts[::_STEP]), lambda x: x <= value)) - 1
    part = F.slice(_constant(starts), coarse * _STEP + 1, F.lit(_STEP))
    return coarse * _STEP + F.size(F.filter(part, lambda x: x <= value)) - 1


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) as (range, pos, guard, doc_id, text, next_text).

    Rows are hash-partitioned by `range` and numbered in it by `pos`.  The first
    document of a range also stands, with `guard` set, at the end of the range
    before, and the very first at the end of the last; so every document finds its
    successor in its own range.  A doc_id that repeats is ordered by text.  A row
    without doc_id has no successor: it is a range of its own and its next_text is null.
    """
    starts = range_starts(docs, "doc_id")
    own = -1 - F.monotonically_increasing_id()
    rows = docs.withColumn("__own", own)
    if starts:
        at = F.when(F.col("doc_id").isNull(), F.col("__own")).otherwise(range_of(F.col("doc_id"), starts).cast("long"))
        rows = rows.withColumn("__at", at)
        before = F.pmod(F.col("__at") - 1, F.lit(len(starts)).cast("long"))
        is_first = (F.col("__at") >= 0) & (F.col("doc_id") == F.get(_constant(starts), F.col("__at").cast("int")))
        here = F.struct(F.col("__at").alias("range"), F.lit(False).alias("guard"))
        guard = F.struct(before.alias("range"), F.lit(True).alias("guard"))
        places = F.when(is_first, F.array(here, guard)).otherwise(F.array(here))
        rows = rows.withColumn("__place", F.explode(places)).select("__place.*", "doc_id", "text")
    else:
        rows = rows.select(F.col("__own").alias("range"), F.lit(False).alias("guard"), "doc_id", "text")
    order = Window.partitionBy("range").orderBy("guard", "doc_id", "text")
    return rows.select(
        "range", F.row_number().over(order).alias("pos"), "guard", "doc_id", "text", F.lead("text").over(order).alias("next_text")
    )
