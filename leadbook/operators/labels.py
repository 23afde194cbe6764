"""Labels: one spelling per value, and the prepared frame every report reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadbook.functions.labels import (
    STATUS_SYNONYMS,
    configuration_synonyms,
    normalize_configuration,
    status_synonyms,
)
from leadbook.functions.money import budget_band, parse_budget
from leadbook.functions.text import clean
from leadbook.runtime import lookup_join, small_copy, stage

# Hand-typed fields whose casing drifts.
CASE_FOLDED_FIELDS = (
    "call_status", "buying_status", "visit_status", "interest_level",
    "configuration_required", "stage", "purpose_of_buying",
)


def with_budget(df: DataFrame) -> DataFrame:
    """Add the budget in Lakh and its price band."""
    value = parse_budget(clean(F.col("budget"))) if "budget" in df.columns else F.lit(None).cast("double")
    return df.withColumn("budget_value", value).withColumn("budget_bucket", budget_band(F.col("budget_value")))


def with_configuration(df: DataFrame) -> DataFrame:
    if "configuration_required" not in df.columns:
        return df
    return df.withColumn("configuration_required", normalize_configuration(F.col("configuration_required")))


def case_variants(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, value, canonical) for every spelling that is not the usual one.

    The usual spelling of a value is the most frequent, ties by alphabet.  One
    scan counts the spellings of all fields; values written one way only, which
    is nearly all of them, never enter the dictionary.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), clean(F.col(f)).alias("value")) for f in fields]))
    spellings = (
        df.select(cells.alias("cell")).select("cell.*").filter(F.col("value").isNotNull())
        .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    # Partitioned by the spellings of one value, already counted, not by its rows.
    usual_first = Window.partitionBy("field", F.lower("value")).orderBy(F.desc("n"), "value")
    ranked = spellings.withColumn("canonical", F.first("value").over(usual_first))
    return ranked.filter(F.col("value") != F.col("canonical")).select("field", "value", "canonical")


def fold_case(df: DataFrame, fields: tuple[str, ...] = CASE_FOLDED_FIELDS, order_col: str = "row_ord") -> DataFrame:
    """Clean the fields and give every value its usual spelling."""
    here = tuple(f for f in fields if f in df.columns)
    if not here:
        return df
    variants = stage(case_variants(df, here), "case_variants")
    local = small_copy(variants)
    out = df.withColumns({f: clean(F.col(f)) for f in here})
    # A dictionary proven small also tells which fields need no lookup at all.
    used = here if local is None else {r["field"] for r in local.select("field").distinct().collect()}
    for field in here:
        if field not in used:
            continue
        source = variants if local is None else local
        entries = source.filter(F.col("field") == field).select(F.col("value").alias(field), "canonical")
        if local is None:
            # Too many spellings over all fields; each field is still checked on its own.
            out = lookup_join(out, entries, [field], order_col)
        else:
            out = out.join(F.broadcast(entries), [field], "left")
        out = out.withColumn(field, F.coalesce("canonical", field)).drop("canonical")
    return out.select(*df.columns)


def fold_synonyms(df: DataFrame) -> DataFrame:
    """Fold wordings of one meaning: configuration per token, statuses as a whole."""
    folds = {f: status_synonyms(F.col(f), f) for f in STATUS_SYNONYMS if f in df.columns}
    if "configuration_required" in df.columns:
        folds["configuration_required"] = configuration_synonyms(F.col("configuration_required"))
    return df.withColumns(folds) if folds else df


def prepare_frame(df: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """Budget, configuration spelling, usual casing, synonyms, in this order."""
    return fold_synonyms(fold_case(with_configuration(with_budget(df)), order_col=order_col))
