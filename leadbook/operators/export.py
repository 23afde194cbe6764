"""Export tables: rows per class, and the ad-audience customer list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.identity import e164, name_parts
from leadbook.functions.money import parse_budget, rupees
from leadbook.functions.text import present, trimmed
from leadbook.operators.rules import CLASSES, classify

# Derived columns that are not exported.
INTERNAL_COLUMNS = ("lead_class_reason", "budget_value", "phone_normalized", "merged_row_count", "merged_sources")

_OWN_COLUMNS = (S.ROW_ORD, S.UPLOAD_ID, S.MEMBER_FRAMES, "name_key", "phone_status", "phone_bucket")


def exportable_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in INTERNAL_COLUMNS and c not in _OWN_COLUMNS]


def class_slice(prepared: DataFrame, rules: list[dict], category: str) -> DataFrame:
    """Rows of one class with the reason they are in it."""
    if category not in CLASSES:
        raise ValueError(f"Unknown lead class {category!r}")
    return classify(prepared, rules).filter(F.col(S.LEAD_CLASS) == category)


def export_rows(classified: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The wanted columns, the reason last.

    A field that is no column is read from the note fields (if its name says so) or
    the extras; it is null where a lead has none.  Without either map it is skipped.
    """
    defaults = exportable_columns(classified)
    read = {c: _exported(classified, c) for c in (columns or defaults)}
    wanted = {c: value for c, value in read.items() if value is not None} or {c: F.col(f"`{c}`") for c in defaults}
    if S.LEAD_REASON in classified.columns:
        wanted.setdefault(S.LEAD_REASON, F.col(S.LEAD_REASON))
    return classified.select(*(value.alias(c) for c, value in wanted.items()))


def _exported(df: DataFrame, field: str):
    if field in df.columns:
        return F.col(f"`{field}`")
    held = S.NOTE_FIELDS if field.startswith(S.NOTE_PREFIX) else S.EXTRAS
    return F.try_element_at(F.col(held), F.lit(field)) if held in df.columns else None


def _first_present(df: DataFrame, *fields: str):
    found = [present(F.col(f)) for f in fields if f in df.columns]
    if S.EXTRAS in df.columns:
        found += [present(F.try_element_at(F.col(S.EXTRAS), F.lit(f))) for f in fields if f not in df.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def ad_audience(df: DataFrame) -> DataFrame:
    """Customer-list rows; a lead with neither phone nor email cannot be matched."""
    first, last = name_parts(_first_present(df, "name"))
    text = lambda *fields: F.coalesce(_first_present(df, *fields), F.lit(""))
    value = F.coalesce(rupees(parse_budget(_first_present(df, "budget"))).cast("string"), F.lit(""))
    rows = df.select(
        F.lower(trimmed(text("email"))).alias("email"),
        e164(_first_present(df, "phone", "phone_2")).alias("phone"),
        first.alias("fn"),
        last.alias("ln"),
        text("current_city", "current_location").alias("ct"),
        F.lit("").alias("st"),
        F.lit("IN").alias("country"),
        value.alias("value"),
    )
    reachable = rows.filter((F.col("phone") != "") | (F.col("email") != ""))
    return reachable.withColumn("currency", F.when(F.col("value") != "", "INR").otherwise(""))
