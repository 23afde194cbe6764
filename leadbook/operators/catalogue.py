"""The field catalogue a rule editor offers, and the upload catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.text import clean
from leadbook.runtime import stage

# Columns no rule is written against, columns with one value per
# lead, and the number of distinct values beyond which a field is not offered.
HIDDEN_FIELDS = (
    "lead_class", "lead_class_reason", "budget_value", "phone_normalized",
    "merged_row_count", "merged_sources", "source_sheet", "project",
)
UNGROUPABLE_FIELDS = ("name", "email", "phone", "qualitative_remarks", "phone_2")
MAX_DISTINCT_VALUES = 300

_OWN_COLUMNS = (S.ROW_ORD, S.UPLOAD_ID, S.MEMBER_FRAMES, "name_key", "phone_status", "phone_bucket", "stamp")


def _offered(name: str) -> bool:
    skipped = (*HIDDEN_FIELDS, *UNGROUPABLE_FIELDS, *_OWN_COLUMNS, S.NOTE_FIELDS, S.EXTRAS)
    return name not in skipped and not name.startswith("Unnamed:")


def _value_counts(cells: DataFrame) -> DataFrame:
    cleaned = cells.withColumn("value", clean(F.col("value"))).filter(F.col("value").isNotNull())
    return cleaned.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def _all_cells(df: DataFrame) -> DataFrame:
    """(field, value) of the offered columns and of the map entries, from one pass over the rows."""
    fields = [c for c in df.columns if _offered(c)]
    cells = [F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])]
    for column in (S.NOTE_FIELDS, S.EXTRAS):
        if column in df.columns:
            entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
            named = F.filter(entries, lambda e: ~e["field"].startswith("Unnamed:") & ~e["field"].isin(*UNGROUPABLE_FIELDS))
            cells.append(F.coalesce(named, F.array().cast("array<struct<field:string,value:string>>")))
    return df.select(F.explode(F.concat(*cells)).alias("cell")).select("cell.field", "cell.value")


def field_values(prepared: DataFrame) -> DataFrame:
    """(field, value, n) of every offered field with at most 300 distinct values.

    The cells are counted once; the counts are stored and both read from there.
    """
    counts = stage(_value_counts(_all_cells(prepared)), "value_counts")
    small = counts.groupBy("field").agg(F.count(F.lit(1)).alias("distinct_values"))
    small = small.filter(F.col("distinct_values") <= MAX_DISTINCT_VALUES)
    return counts.join(small, "field").select("field", "value", "n")


def field_catalogue(prepared: DataFrame) -> DataFrame:
    """Offered fields with label, fill rate and sorted values, best covered first."""
    total = prepared.count()
    from_notes = F.col("field").startswith(S.NOTE_PREFIX)
    note_label = F.concat(F.expr(f"substring(field, {len(S.NOTE_PREFIX) + 1})"), F.lit("  (from notes)"))
    # At most 300 values are collected per field.
    grouped = field_values(prepared).groupBy("field").agg(
        F.sum("n").alias("filled"), F.array_sort(F.collect_list("value")).alias("values")
    )
    return grouped.select(
        "field",
        F.when(from_notes, note_label).otherwise(F.replace(F.col("field"), F.lit("_"), F.lit(" "))).alias("label"),
        from_notes.alias("from_notes"),
        "filled",
        F.round(F.col("filled") / total, 4).alias("fill_rate"),
        "values",
    ).orderBy(F.desc("fill_rate"), "field")


def upload_catalogue(uploads: DataFrame, drafts: DataFrame | None = None, created_col: str = "created_at") -> DataFrame:
    """One row per upload: status, creation time, files and size, newest first.

    `uploads` are the stored ones as the ledger lists them, counted in leads.
    `drafts` are rows read but not yet accepted, counted as they are.
    """
    if drafts is not None:
        counted = drafts.groupBy(S.UPLOAD_ID).agg(
            F.min(created_col).alias(created_col),
            F.array_join(F.array_sort(F.collect_set(S.SOURCE_FILE)), ", ").alias("files"),
            F.count(F.lit(1)).alias("row_count"),
            F.lit("draft").alias("status"),
        )
        uploads = uploads.unionByName(counted)
    return uploads.orderBy(F.desc(created_col), S.UPLOAD_ID)
