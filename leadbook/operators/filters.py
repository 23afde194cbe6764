"""Slices of a prepared frame: the report's filters and segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.operators.rules import CATEGORIES, classify
from leadbook.operators.summaries import is_hwc


@dataclass(frozen=True)
class Filters:
    """What to keep; an unset field keeps everything.  Budgets are in Crore."""

    property_type: str | None = None
    source_file: str | None = None
    budget_min: float | None = None
    budget_max: float | None = None
    configuration: tuple[str, ...] = ()
    call_status: tuple[str, ...] = ()
    buying_status: tuple[str, ...] = ()
    hwc_only: bool = False
    segment: str | None = None

    @property
    def empty(self) -> bool:
        return self == Filters()


def value_list(values: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    """Filter values as a tuple; lists are taken as they are, so a value may hold a comma."""
    if values is None:
        return ()
    if isinstance(values, str):
        values = values.split(",")
    return tuple(v.strip() for v in values if v and v.strip())


def apply_filters(prepared: DataFrame, filters: Filters) -> DataFrame:
    """Narrow a prepared frame; a lead without a budget fails both bounds."""
    out = prepared
    for column, wanted in ((S.PROPERTY_TYPE, filters.property_type), (S.SOURCE_FILE, filters.source_file)):
        if wanted and wanted.lower() != "all":
            out = out.filter(F.col(column) == wanted)
    if filters.budget_min is not None:
        out = out.filter(F.col("budget_value") >= filters.budget_min * 100)
    if filters.budget_max is not None:
        out = out.filter(F.col("budget_value") <= filters.budget_max * 100)
    for column in ("configuration", "call_status", "buying_status"):
        wanted = getattr(filters, column)
        field = "configuration_required" if column == "configuration" else column
        if wanted:
            out = out.filter(F.col(field).isin(*wanted))
    return out.filter(is_hwc(out)) if filters.hwc_only else out


def apply_segment(prepared: DataFrame, segment: str | None, rules: list[dict]) -> DataFrame:
    """Priority, good or bad leads; without rules nothing is good or bad."""
    wanted = (segment or "").lower()
    if wanted == "hwc":
        return prepared.filter(is_hwc(prepared))
    if wanted in CATEGORIES:
        if not rules:
            return prepared.limit(0)
        classified = classify(prepared, rules)
        return classified.filter(F.col(S.LEAD_CLASS) == wanted).select(*prepared.columns)
    return prepared


def slice_frame(prepared: DataFrame, filters: Filters, rules: list[dict]) -> DataFrame:
    return apply_segment(apply_filters(prepared, filters), filters.segment, rules)
