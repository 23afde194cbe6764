"""Summary sections: totals, budget, fill rates, the call list, headlines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.counting import leads as lead_count
from leadbook.functions.flags import QUALITY_FIELDS, hwc_flag, quality_flag
from leadbook.functions.money import band_position, crore
from leadbook.functions.text import clean, present, trimmed

# The fields whose fill rate bounds what the charts can show.
TRACKED_FIELDS = (
    "phone", "name", "budget", "configuration_required", "hwc",
    "call_status", "buying_status", "qualitative_remarks", "date",
)
CALL_LIST_SIZE = 20
REMARK_SAMPLE = 40
REMARK_CHARS = 120
IS_HWC, IS_QUALITY = "is_hwc", "is_quality"
HWC_LABELS = ("HWC-marked", "Not marked")


def column_or_null(df: DataFrame, name: str) -> Column:
    """A missing column reads as all null."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def is_hwc(df: DataFrame) -> Column:
    if IS_HWC in df.columns:
        return F.col(IS_HWC)
    return hwc_flag(column_or_null(df, "hwc"), column_or_null(df, "client_status"))


def is_quality(df: DataFrame) -> Column:
    if IS_QUALITY in df.columns:
        return F.col(IS_QUALITY)
    return quality_flag(*[F.col(f) for f in QUALITY_FIELDS if f in df.columns])


def with_flags(df: DataFrame) -> DataFrame:
    """Both flags as columns, so that no section works them out again."""
    return df.withColumns({IS_HWC: is_hwc(df), IS_QUALITY: is_quality(df)})


def hwc_label(df: DataFrame) -> Column:
    return F.when(is_hwc(df), HWC_LABELS[0]).otherwise(HWC_LABELS[1])


def class_label(df: DataFrame) -> Column:
    """Good or Bad; an unclassified lead has no label."""
    label = F.initcap(column_or_null(df, S.LEAD_CLASS))
    return F.when(label != "Unclassified", label)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 4))


def quality_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg(is_quality(df).cast("int")), 4).alias("quality_rate"))


def report_meta(df: DataFrame, counted: str | None = None) -> DataFrame:
    """One row: leads and quality rate, null without leads."""
    sums = df.agg(lead_count(None, counted).alias("total_leads"), lead_count(is_quality(df), counted).alias("good"))
    rate = F.when(F.col("total_leads") > 0, F.round(F.col("good") / F.col("total_leads"), 4))
    return sums.select("total_leads", rate.alias("quality_rate"))


def report_scope(df: DataFrame) -> DataFrame:
    """Distinct property types and source files, as rows."""
    kinds = {"property_type": S.PROPERTY_TYPE, "source_file": S.SOURCE_FILE}
    here = {k: c for k, c in kinds.items() if c in df.columns}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in here.items()])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    return long.distinct().orderBy("kind", "value")


def core_summary(df: DataFrame, counted: str | None = None) -> DataFrame:
    """One row: total, priority leads and their share."""
    sums = df.agg(lead_count(None, counted).alias("total"), lead_count(is_hwc(df), counted).alias("hwc"))
    return sums.withColumn("hwc_share", _share(F.col("hwc"), F.col("total")))


def hwc_split(df: DataFrame, counted: str | None = None) -> DataFrame:
    """The two slices, priority leads and the rest."""
    slices = F.array(
        F.struct(F.lit(HWC_LABELS[0]).alias("label"), F.col("hwc").alias("count")),
        F.struct(F.lit(HWC_LABELS[1]).alias("label"), (F.col("total") - F.col("hwc")).alias("count")),
    )
    return core_summary(df, counted).select(F.explode(slices).alias("s")).select("s.*")


def budget_counts(df: DataFrame, counted: str | None = None) -> DataFrame:
    """Leads per (budget, band, quality): at most a million rows at any data size.

    Budgets have two decimals and an upper bound, so everything the budget
    section shows comes exactly from this table instead of from the leads.
    """
    return df.groupBy("budget_value", "budget_bucket", is_quality(df).alias("quality")).agg(
        lead_count(None, counted).alias("n")
    )


def _exact(value: str) -> Column:
    return F.col(value).cast("decimal(12,2)")


def budget_summary(counts: DataFrame) -> DataFrame:
    """One row: parsed and unparsed leads, and range, median and mean in Crore."""
    parsed = F.col("budget_value").isNotNull()
    parsed_rows = F.sum(F.when(parsed, F.col("n")).otherwise(0))
    total = F.sum("n")
    mean = (F.sum(_exact("budget_value") * F.col("n")) / F.sum(F.when(parsed, F.col("n")))).cast("double")
    return counts.agg(
        F.coalesce(total, F.lit(0)).alias("total_rows"),
        F.coalesce(parsed_rows, F.lit(0)).alias("parsed_count"),
        F.coalesce(total - parsed_rows, F.lit(0)).alias("unparsed_count"),
        crore(F.min("budget_value")).alias("min"),
        crore(F.max("budget_value")).alias("max"),
        crore(F.percentile("budget_value", 0.5, F.col("n"))).alias("median"),
        crore(mean).alias("mean"),
    )


def budget_bands(counts: DataFrame) -> DataFrame:
    """Per price band with data, in band order."""
    good = F.sum(F.when(F.col("quality"), F.col("n")).otherwise(0))
    bands = counts.filter(F.col("budget_bucket").isNotNull()).groupBy("budget_bucket").agg(
        F.sum("n").alias("count"),
        crore(F.min("budget_value")).alias("min"),
        crore(F.max("budget_value")).alias("max"),
        F.round(good / F.sum("n"), 4).alias("quality_rate"),
    )
    return bands.select(
        F.col("budget_bucket").alias("label"), band_position(F.col("budget_bucket")).alias("position"),
        "count", "min", "max", "quality_rate",
    ).orderBy("position")


def data_quality(df: DataFrame) -> DataFrame:
    """Filled, missing and fill rate of each tracked field, from one wide row."""
    fields = [f for f in TRACKED_FIELDS if f in df.columns]
    return fill_rates(df.agg(F.count(F.lit(1)).alias("total"), *[F.count(clean(F.col(f))).alias(f) for f in fields]))


def fill_rates(wide: DataFrame) -> DataFrame:
    """The same from one row: the total and the filled leads of each field."""
    fields = [c for c in wide.columns if c != "total"]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])
    long = wide.select("total", F.explode(rows).alias("r")).select("total", "r.*")
    return long.select(
        "field",
        "filled",
        (F.col("total") - F.col("filled")).alias("missing"),
        _share(F.col("filled"), F.col("total")).alias("fill_rate"),
    )


def merge_quality(leads: DataFrame) -> DataFrame:
    """One row: leads built from several rows, and rows absorbed by merging."""
    rows = F.coalesce(F.col(S.MERGED_COUNT), F.lit(1))
    return leads.agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(rows > 1).alias("merged_leads"),
        F.coalesce(F.sum(rows - 1), F.lit(0)).alias("rows_absorbed"),
    )


def call_list(df: DataFrame, limit: int = CALL_LIST_SIZE, order_col: str = S.ROW_ORD) -> DataFrame:
    """Priority leads, largest budget first; a top-k, so no full sort."""
    text = lambda c: present(column_or_null(df, c))
    ranked = df.filter(is_hwc(df)).orderBy(F.desc_nulls_last("budget_value"), order_col).limit(limit)
    return ranked.select(
        F.coalesce(text("name"), F.lit("(no name)")).alias("name"),
        text("phone").alias("phone"),
        text("hwc").alias("hwc"),
        text("budget").alias("budget"),
        text("configuration_required").alias("configuration"),
        text("buying_status").alias("buying_status"),
        text("call_status").alias("call_status"),
        text("qualitative_remarks").alias("remarks"),
    )


def remark_sample(df: DataFrame, limit: int = REMARK_SAMPLE, order_col: str = S.ROW_ORD) -> DataFrame:
    """The first remarks in row order, shortened for display."""
    remark = trimmed(F.col("qualitative_remarks"))
    noted = df.filter(remark != "").orderBy(order_col).limit(limit)
    return noted.select(order_col, F.substring(remark, 1, REMARK_CHARS).alias("remark"))


def headline(
    df: DataFrame, budgets: DataFrame, configurations: DataFrame, counted: str | None = None
) -> DataFrame:
    """The headline tiles, one row each.

    `budgets` is `budget_counts`, `configurations` the top of the configuration
    distribution.
    """
    tile = lambda name, value, share: F.struct(
        F.lit(name).alias("tile"), value.cast("string").alias("value"), share.cast("double").alias("detail")
    )
    core = core_summary(df, counted).select(
        F.explode(
            F.array(
                tile("total_leads", F.col("total"), F.lit(None)),
                tile("hwc_marked", F.col("hwc"), F.col("hwc_share")),
            )
        ).alias("t")
    )
    budget = budget_summary(budgets).select(tile("median_budget", F.col("median"), F.col("parsed_count")).alias("t"))
    top = configurations.orderBy(F.desc("count"), "value").limit(1)
    config = top.select(tile("top_configuration", F.col("value"), F.col("share")).alias("t"))
    return reduce(DataFrame.unionByName, [core, budget, config]).select("t.*")
