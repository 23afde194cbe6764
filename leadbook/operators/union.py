"""Bringing sheets together: the tagged union of prepared sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.text import present
from leadbook.operators.headers import apply_mapping, ensure_canonical, normalize_headers
from leadbook.operators.notes import lift_notes


def project_label(lead_for_project: Column, sheet: Column) -> Column:
    """The lead's own project, else its sheet, else `Unknown`."""
    return F.coalesce(present(lead_for_project), present(sheet), F.lit("Unknown"))


def with_project(df: DataFrame) -> DataFrame:
    return df.withColumn(S.PROJECT, project_label(F.col("lead_for_project"), F.col(S.SOURCE_SHEET)))


def prepare_sheet(df: DataFrame, mapping: dict[str, str] | None = None, note_proposals: dict[str, str] | None = None) -> DataFrame:
    """One sheet in canonical shape: mapped, renamed, notes lifted, gaps filled."""
    named = normalize_headers(apply_mapping(df, mapping or {}))
    return ensure_canonical(lift_notes(named, note_proposals))


def empty_leads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.LEAD_ROW_SCHEMA)


def union_sheets(spark: SparkSession, sheets: list[DataFrame]) -> DataFrame:
    """All sheets in one frame; none gives an empty frame of the same shape."""
    if not sheets:
        return empty_leads(spark)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)
