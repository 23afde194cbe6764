"""Sheets: virtual sheets per campaign, property types, the catalogue, user choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.text import trimmed
from leadbook.operators.headers import wants_proposal
from leadbook.runtime import lookup_join

# Property types with the words that name them, in matching order.
PROPERTY_TYPES = {
    "Apartment": ("apartment", "apt", "flat"),
    "Bungalow": ("bungalow", "villa", "independent house", "row house"),
    "Plot": ("plot", "land"),
    "Penthouse": ("penthouse",),
    "Mixed / Other": ("excel", "mixed", "other", "ivr"),
}

SHEET_KEYS = (S.SOURCE_FILE, S.SOURCE_SHEET)


def property_type(name: Column) -> Column:
    """The first property type whose word, or its plural, is in the name."""
    text = F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")
    chain = None
    for label, words in PROPERTY_TYPES.items():
        found = text.rlike(rf"\b(?:{'|'.join(words)})s?\b")
        chain = F.when(found, label) if chain is None else chain.when(found, label)
    return chain


def sheet_property_type(file: Column, sheet: Column) -> Column:
    """The sheet's own name decides, then the file's."""
    return F.coalesce(property_type(sheet), property_type(file))


def virtual_sheet(sheet: Column, campaign: Column) -> Column:
    """`Sheet [campaign]`; a blank campaign is a sheet of its own."""
    label = trimmed(F.coalesce(campaign, F.lit("")))
    label = F.when(F.lower(label).isin("", "nan"), "No campaign").otherwise(label)
    return F.concat(sheet, F.lit(" ["), label, F.lit("]"))


def with_virtual_sheets(df: DataFrame) -> DataFrame:
    """Split each sheet by campaign, as a column: no rows move.

    A sheet of a file without a campaign column stays whole, under its own name.
    """
    if "campaign" not in df.columns:
        return df
    split = virtual_sheet(F.col(S.SOURCE_SHEET), F.col("campaign"))
    if S.HAS_CAMPAIGN in df.columns:
        split = F.when(F.col(S.HAS_CAMPAIGN), split).otherwise(F.col(S.SOURCE_SHEET))
    return df.withColumn(S.SOURCE_SHEET, split).drop(S.HAS_CAMPAIGN)


def sheet_catalogue(df: DataFrame, matches: DataFrame | None = None, matched: int | None = None) -> DataFrame:
    """One row per virtual sheet: rows, matched fields, lead-likeness, detected type.

    `matches` gives (source_file, matched_fields, column_count) where files have
    their own headers, and the sheets that are worth a column proposal are marked;
    `matched` is one count for all of them.  Types are read from the
    distinct sheet names, never per row.
    """
    sheets = df.groupBy(*SHEET_KEYS).agg(F.count(F.lit(1)).alias("row_count"))
    if matches is not None:
        sheets = sheets.join(matches, S.SOURCE_FILE, "left")
    else:
        sheets = sheets.withColumn("matched_fields", F.lit(matched or 0).cast("long"))
    if "column_count" in sheets.columns:
        gate = wants_proposal(F.col("matched_fields"), F.col("column_count"), F.col("row_count"))
        sheets = sheets.withColumn("wants_proposal", F.coalesce(gate, F.lit(False)))
    return sheets.withColumns(
        {
            "looks_like_lead_sheet": F.coalesce(F.col("matched_fields") >= 5, F.lit(False)),
            "detected_type": sheet_property_type(F.col(S.SOURCE_FILE), F.col(S.SOURCE_SHEET)),
        }
    )


class SelectionError(ValueError):
    """The chosen sheets cannot be merged as they stand."""


def chosen_sheets(catalogue: DataFrame, choices: DataFrame) -> DataFrame:
    """Catalogue rows to merge, with the property type the user gave each.

    `choices` has (source_file, source_sheet, include, property_type).  A sheet
    without a choice is included if it looks like leads.
    """
    picked = choices.select(*SHEET_KEYS, "include", F.col("property_type").alias("__type"))
    joined = catalogue.join(picked, list(SHEET_KEYS), "left")
    include = F.coalesce(F.col("include"), F.col("looks_like_lead_sheet"))
    return joined.filter(include).withColumn(
        "property_type", F.nullif(trimmed(F.col("__type")), F.lit(""))
    ).drop("include", "__type")


def check_selection(selected: DataFrame) -> DataFrame:
    """Refuse an empty selection, or an included sheet without a property type."""
    total, untyped, example = selected.agg(
        F.count(F.lit(1)),
        F.count_if(F.col("property_type").isNull()),
        F.min(F.when(F.col("property_type").isNull(), F.concat_ws(" in ", S.SOURCE_SHEET, S.SOURCE_FILE))),
    ).first()
    if total == 0:
        raise SelectionError("no sheet is included")
    if untyped:
        raise SelectionError(f"{untyped} included sheets have no property type, for example {example}")
    return selected


def keep_chosen(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of the selected sheets, tagged with their property type."""
    table = selected.select(*SHEET_KEYS, F.col("property_type").alias("__type"))
    tagged = lookup_join(rows.drop(S.PROPERTY_TYPE), table, list(SHEET_KEYS), S.ROW_ORD)
    return tagged.filter(F.col("__type").isNotNull()).withColumnRenamed("__type", S.PROPERTY_TYPE)
