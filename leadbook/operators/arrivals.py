"""When leads arrive: weekday, month, hour, and the weekday-by-hour grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook.functions.timing import has_clock_time, parse_timestamp

# Day order, timestamp columns by preference, and the least number of
# timed leads for which hours are shown.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
STAMP_COLUMNS = ("date", "first_call_date", "last_activity")
MIN_TIMED_LEADS = 30


def day_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAYS]), weekday + 1)


def stamp_column(df: DataFrame) -> str | None:
    """The first timestamp column with any readable date in the whole frame.

    Stops at the first readable row; a column is read to its end only when it
    has none.
    """
    for name in STAMP_COLUMNS:
        if name in df.columns and not df.filter(parse_timestamp(F.col(name)).isNotNull()).isEmpty():
            return name
    return None


def with_stamp(df: DataFrame) -> DataFrame:
    """Add `stamp`, read from the column chosen for the frame."""
    name = stamp_column(df)
    value = parse_timestamp(F.col(name)) if name else F.lit(None).cast("timestamp")
    return df.withColumn("stamp", value)


def arrival_counts(stamped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Leads per month, weekday, hour and kind of stamp, and per `keys`: one small table for all views."""
    stamp = F.col("stamp")
    return stamped.groupBy(
        *keys,
        F.date_format(stamp, "yyyy-MM").alias("month"),
        F.weekday(stamp).alias("weekday"),
        F.hour(stamp).alias("hour"),
        has_clock_time(stamp).alias("timed"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("first_stamp"), F.max(stamp).alias("last_stamp"))


def arrival_header(counts: DataFrame) -> DataFrame:
    """One row: dated and timed leads, the range, and whether hours are shown."""
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n")).otherwise(0)), F.lit(0))
    sums = counts.agg(
        total(F.col("month").isNotNull()).alias("dated_leads"),
        total(F.lit(True)).alias("total_leads"),
        total(F.col("timed")).alias("timed_leads"),
        F.min("first_stamp").alias("range_start"),
        F.max("last_stamp").alias("range_end"),
    )
    return sums.withColumns(
        {
            "available": F.col("dated_leads") > 0,
            "has_time_of_day": F.col("timed_leads") >= MIN_TIMED_LEADS,
            "min_timed_leads": F.lit(MIN_TIMED_LEADS).cast("long"),
        }
    )


def by_weekday(counts: DataFrame) -> DataFrame:
    """Seven rows, Monday first, zeros filled."""
    days = counts.sparkSession.range(len(DAYS)).select(F.col("id").cast("int").alias("weekday"))
    seen = counts.filter(F.col("month").isNotNull()).groupBy("weekday").agg(F.sum("n").alias("n"))
    return (
        days.join(F.broadcast(seen), "weekday", "left")
        .select("weekday", day_name(F.col("weekday")).alias("label"), F.coalesce("n", F.lit(0)).alias("count"))
        .orderBy("weekday")
    )


def by_month(counts: DataFrame) -> DataFrame:
    """Observed months, ascending."""
    dated = counts.filter(F.col("month").isNotNull())
    return dated.groupBy(F.col("month").alias("label")).agg(F.sum("n").alias("count")).orderBy("label")


def _shown_hours(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Timed leads per key; nothing at all below the gate."""
    timed = counts.filter(F.col("timed")).groupBy(*keys).agg(F.sum("n").alias("n"))
    everything = F.expr("sum(n) OVER ()")  # at most 168 rows
    return timed.withColumn("__timed", everything).filter(F.col("__timed") >= MIN_TIMED_LEADS).drop("__timed")


def by_hour(counts: DataFrame) -> DataFrame:
    """24 rows when enough leads carry a clock time, else none."""
    seen = _shown_hours(counts, ["hour"])
    shown = seen.agg(F.count(F.lit(1)).alias("groups")).filter(F.col("groups") > 0)
    hours = shown.select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return (
        hours.join(F.broadcast(seen), "hour", "left")
        .select("hour", F.format_string("%02d:00", "hour").alias("label"), F.coalesce("n", F.lit(0)).alias("count"))
        .orderBy("hour")
    )


def weekday_by_hour(counts: DataFrame) -> DataFrame:
    """The dense 7 x 24 grid, behind the same gate."""
    seen = _shown_hours(counts, ["weekday", "hour"])
    shown = seen.agg(F.count(F.lit(1)).alias("groups")).filter(F.col("groups") > 0)
    cells = shown.select(F.explode(F.sequence(F.lit(0), F.lit(167))).alias("cell"))
    grid = cells.select(F.expr("cell div 24").cast("int").alias("weekday"), (F.col("cell") % 24).alias("hour"))
    return (
        grid.join(F.broadcast(seen), ["weekday", "hour"], "left")
        .select("weekday", day_name(F.col("weekday")).alias("day"), "hour", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("weekday", "hour")
    )


def peaks(counts: DataFrame) -> DataFrame:
    """Busiest weekday and, behind the gate, busiest hour; the earliest wins ties."""
    best = lambda label, order: F.max_by(label, F.struct(F.col("count"), -F.col(order)))
    day = by_weekday(counts).agg(best("label", "weekday").alias("label"), F.max("count").alias("count"))
    hour_span = F.concat(
        F.format_string("%02d:00", "hour"), F.lit("–"), F.format_string("%02d:00", (F.col("hour") + 1) % 24)
    )
    hour = by_hour(counts).withColumn("span", hour_span).agg(
        best("span", "hour").alias("label"), F.max("count").alias("count")
    )
    named = lambda df, kind: df.filter(F.col("count") > 0).select(F.lit(kind).alias("kind"), "label", "count")
    return named(day, "weekday").unionByName(named(hour, "hour"))
