"""From export files to the lead book."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.operators.headers import ensure_canonical, valid_proposals
from leadbook.operators.identity import PHONE_STATUS, dedupe_stats, merge_leads, standardise
from leadbook.operators.notes import lift_notes
from leadbook.operators.sheets import (
    SHEET_KEYS,
    check_selection,
    chosen_sheets,
    keep_chosen,
    sheet_catalogue,
    with_virtual_sheets,
)
from leadbook.operators.union import with_project
from leadbook.runtime import lookup_join, stage
from leadbook.sources.exports import read_exports


@dataclass(frozen=True)
class Draft:
    """Rows read but not yet accepted, and what was found in them."""

    rows: DataFrame
    catalogue: DataFrame


def read_draft(
    spark: SparkSession, paths: list[str] | str, mappings: dict[str, dict[str, str]] | None = None
) -> Draft:
    """Read files, split sheets by campaign, and describe every virtual sheet."""
    rows, matches = read_exports(spark, paths, mappings)
    split = with_virtual_sheets(rows)
    return Draft(split, stage(sheet_catalogue(split, matches), "catalogue"))


def accepted_proposals(draft: Draft, proposals: DataFrame) -> dict[str, dict[str, str]]:
    """Mappings for `read_draft` from proposals (source_file, source_col, target_field, ord).

    Only files with a sheet that wants a proposal take one; the first claim on a
    field wins, and the reader passes over columns that the file lacks.
    """
    gated = draft.catalogue.filter("wants_proposal").select(S.SOURCE_FILE).distinct()
    named = proposals.join(gated, S.SOURCE_FILE, "left_semi").withColumnRenamed(S.SOURCE_FILE, "sheet_key")
    checked = valid_proposals(named, named.select("sheet_key", "source_col").distinct())
    mappings: dict[str, dict[str, str]] = {}
    for row in checked.collect():  # at most one row per proposed field of a file
        mappings.setdefault(row["sheet_key"], {})[row["source_col"]] = row["target_field"]
    return mappings


def detected_choices(catalogue: DataFrame) -> DataFrame:
    """The choices a user makes by accepting what was detected."""
    return catalogue.select(
        *SHEET_KEYS,
        F.col("looks_like_lead_sheet").alias("include"),
        F.coalesce("detected_type", F.lit("Mixed / Other")).alias("property_type"),
    )


def confirm(draft: Draft, choices: DataFrame, note_proposals: dict[str, str] | None = None) -> DataFrame:
    """Lead rows of the chosen sheets: typed, notes lifted, canonical, with a project."""
    selected = check_selection(stage(chosen_sheets(draft.catalogue, choices), "selected_sheets"))
    rows = keep_chosen(draft.rows, selected)
    lifted = lift_notes(rows, note_proposals)
    return with_project(ensure_canonical(lifted))


def stored_rows(rows: DataFrame) -> DataFrame:
    """Lead rows keyed for merging.

    Merging reads rows with maps twice, so these are written once, unless they carry their
    keys and so come from a store.
    """
    keyed = standardise(rows)
    twice = bool({S.EXTRAS, S.NOTE_FIELDS} & set(rows.columns))
    return stage(keyed, "lead_rows") if twice and PHONE_STATUS not in rows.columns else keyed


def build_lead_book(rows: DataFrame) -> DataFrame:
    """Unique leads of these rows, stored: every later step reads them more than once."""
    return stage(merge_leads(stored_rows(rows)), "lead_book")


def combined_pool(uploads: DataFrame) -> DataFrame:
    """Unique leads over all uploads.

    Merged from the uploads' rows, not from their merged frames, so lineage
    counts real rows; `member_frames` counts the uploads a lead came from.
    """
    return build_lead_book(renumber_uploads(uploads))


def renumber_uploads(uploads: DataFrame) -> DataFrame:
    """One row order over several uploads: uploads in order of arrival, rows as they were."""
    sizes = uploads.groupBy(S.UPLOAD_ID).agg(F.min("created_at").alias("at"), F.max(S.ROW_ORD).alias("last"))
    # One row per upload: a running sum over a list of uploads, not over leads.
    start = F.expr(
        f"coalesce(sum(last + 1) OVER (ORDER BY at, {S.UPLOAD_ID} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    starts = sizes.select(S.UPLOAD_ID, start.alias("__start"))
    placed = lookup_join(uploads, starts, [S.UPLOAD_ID], S.ROW_ORD)
    return placed.withColumn(S.ROW_ORD, F.col(S.ROW_ORD) + F.col("__start")).drop("__start", "created_at")


def upload_stats(uploads: DataFrame) -> DataFrame:
    """Merge statistics of each upload on its own."""
    return dedupe_stats(uploads, by=(S.UPLOAD_ID,))
