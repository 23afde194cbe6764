"""The report: every section of one prepared frame as a small long-format table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.operators import arrivals, crosstabs, distributions, summaries
from leadbook.operators.cube import Cube, N, build_cube
from leadbook.operators.filters import Filters, slice_frame
from leadbook.operators.labels import prepare_frame
from leadbook.operators.rules import classification_summary, classify, ranked_reasons
from leadbook.operators.summaries import class_label, column_or_null, hwc_label
from leadbook.runtime import stage

# Cross-tab captions shown when a chart has data.
CAPTIONS = {
    "hwc_x_config": "Which unit types your priority (HWC-marked) clients are asking for.",
    "hwc_x_budget": "Whether priority clients sit in higher price bands than everyone else.",
    "buying_status_x_config": "Whether leads closer to buying cluster around particular unit types.",
    "call_status_x_buying": "Whether leads you could not reach were actually warm buyers.",
    "config_x_budget": "Which unit types sit in which price bands.",
    "lead_class_x_budget": "Whether the leads your rules call good carry bigger budgets.",
    "lead_class_x_config": "Which unit types the leads your rules call good are asking for.",
    "lead_class_x_call_status": "Whether the leads your rules call good are the ones you actually reach.",
}


def distribution_fields(df: DataFrame) -> dict[str, Column]:
    """The charted fields and the columns they come from."""
    names = {
        "hwc": "hwc", "call_status": "call_status", "buying_status": "buying_status",
        "configuration": "configuration_required", "pages": "facebook_page",
        "campaigns": "campaign", "ad_sets": "facebook_ad_set",
    }
    fields = {label: column_or_null(df, column) for label, column in names.items()}
    if S.LEAD_CLASS in df.columns:
        fields["lead_class"] = class_label(df)
    return fields


def crosstab_sections(df: DataFrame) -> dict[str, tuple[Column, Column]]:
    """The fixed cross-tabs; those by lead class only for a classified frame."""
    config, band = column_or_null(df, "configuration_required"), column_or_null(df, "budget_bucket")
    buying, call = column_or_null(df, "buying_status"), column_or_null(df, "call_status")
    sections = {
        "config_x_budget": (config, band),
        "hwc_x_config": (hwc_label(df), config),
        "hwc_x_budget": (hwc_label(df), band),
        "buying_status_x_config": (buying, config),
        "call_status_x_buying": (call, buying),
    }
    if S.LEAD_CLASS in df.columns:
        verdict = class_label(df)
        sections["lead_class_x_budget"] = (verdict, band)
        sections["lead_class_x_config"] = (verdict, config)
        sections["lead_class_x_call_status"] = (verdict, call)
    return sections


def report_counts(df: DataFrame) -> DataFrame:
    return distributions.field_counts(df, distribution_fields(df))


def report_cells(df: DataFrame) -> DataFrame:
    return crosstabs.crosstab_cells(df, crosstab_sections(df))


def availability(
    counts: DataFrame, cells: DataFrame, budgets: DataFrame, arrivals_header: DataFrame, core: DataFrame
) -> DataFrame:
    """(section, available): which parts of the report have data.

    Reads the small section tables only.  Class sections need a lead that a rule
    has called good or bad.
    """
    section_names = ("lead_class", "call_status", "buying_status", "configuration")
    flagged = lambda name, condition: F.struct(F.lit(name).alias("section"), condition.alias("available"))
    present = F.collect_set("field")
    listed = lambda f: F.array_contains(F.col("seen"), f)
    marketing = {"marketing_pages": "pages", "marketing_campaigns": "campaigns", "marketing_ad_sets": "ad_sets"}
    by_field = counts.agg(present.alias("seen")).select(
        F.explode(
            F.array(
                *[flagged("classification" if f == "lead_class" else f, listed(f)) for f in section_names],
                *[flagged(name, listed(f)) for name, f in marketing.items()],
                flagged("marketing", F.arrays_overlap("seen", F.array(*[F.lit(f) for f in marketing.values()]))),
            )
        ).alias("f")
    )
    by_crosstab = crosstabs.counted_cells(cells).agg(F.collect_set("section").alias("seen")).select(
        F.explode(F.array(*[flagged(name, listed(name)) for name in CAPTIONS])).alias("f")
    )
    by_budget = budgets.agg(F.count("budget_bucket").alias("n")).select(flagged("budget", F.col("n") > 0).alias("f"))
    by_core = core.select(flagged("hwc", F.col("hwc") > 0).alias("f"))
    by_time = arrivals_header.select(
        F.explode(
            F.array(flagged("time", F.col("available")), flagged("time_of_day", F.col("has_time_of_day")))
        ).alias("f")
    )
    parts = [by_field, by_crosstab, by_budget, by_core, by_time]
    return reduce(DataFrame.unionByName, parts).select("f.*").orderBy("section")


def captions(cells: DataFrame) -> DataFrame:
    """A caption per cross-tab that has data."""
    table = F.create_map(*[F.lit(x) for pair in CAPTIONS.items() for x in pair])
    sections = crosstabs.counted_cells(cells).select("section").distinct()
    return sections.select("section", F.try_element_at(table, F.col("section")).alias("caption"))


class Sections(Mapping):
    """Sections by name, each planned when it is first asked for and kept."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __len__(self) -> int:
        return len(self._makers)


def report_sections(cube: Cube, rows: DataFrame, staged: bool = True) -> Sections:
    """All sections of the leads that `cube` counts; `rows` are the same leads.

    Only the call list and the remarks read leads.  Everything else is summed from
    the cube by way of four small tables, which are stored on first use so that no
    section sums them again.
    """
    keep = (lambda df, label: stage(df, label)) if staged else (lambda df, label: df)
    counts = cache(lambda: keep(cube.counts(), "report_counts"))
    cells = cache(lambda: keep(cube.cells(crosstab_sections), "report_cells"))
    budgets = cache(lambda: keep(cube.budgets(), "report_budgets"))
    arrived = cache(lambda: keep(cube.arrivals(), "report_arrivals"))
    field = lambda name: counts().filter(F.col("field") == name)
    core = lambda: summaries.core_summary(cube.totals, N)
    header = lambda: arrivals.arrival_header(arrived())
    configurations = lambda: distributions.distribution(field("configuration"))
    makers = {
        "meta": lambda: summaries.report_meta(cube.totals, N),
        "scope": lambda: summaries.report_scope(cube.totals),
        "data_quality": cube.fill,
        "core": core,
        "hwc_split": lambda: summaries.hwc_split(cube.totals, N),
        "hwc_raw_values": lambda: distributions.distribution(field("hwc"), top=6),
        "call_list": lambda: summaries.call_list(rows),
        "budget": lambda: summaries.budget_summary(budgets()),
        "budget_bands": lambda: summaries.budget_bands(budgets()),
        "distributions": lambda: distributions.distribution(counts()),
        "slices": lambda: distributions.fold_slices(counts()),
        "crosstabs": lambda: crosstabs.crosstab(cells()),
        "coverage": lambda: crosstabs.coverage(cells()),
        "chart_matrices": lambda: crosstabs.fold_matrix(cells()),
        "captions": lambda: captions(cells()),
        "arrivals": header,
        "by_weekday": lambda: arrivals.by_weekday(arrived()),
        "by_month": lambda: arrivals.by_month(arrived()),
        "by_hour": lambda: arrivals.by_hour(arrived()),
        "weekday_by_hour": lambda: arrivals.weekday_by_hour(arrived()),
        "peaks": lambda: arrivals.peaks(arrived()),
        "headline": lambda: summaries.headline(cube.totals, budgets(), configurations(), N),
        "remarks": lambda: summaries.remark_sample(rows),
        "availability": lambda: availability(counts(), cells(), budgets(), header(), core()),
    }
    if cube.counts_merges:
        makers["merge_quality"] = cube.merge_quality
    if cube.classified:
        makers["classification"] = lambda: classification_summary(cube.totals, N)
        makers["unclassified_reasons"] = lambda: ranked_reasons(cube.reasons())
    return Sections(makers)


def report_cube(prepared: DataFrame, rules: list[dict] | None = None) -> Cube:
    return build_cube(classify(prepared, rules) if rules else prepared)


def full_report(prepared: DataFrame, rules: list[dict] | None = None, staged: bool = True) -> Sections:
    """All sections of a prepared frame, keyed by name.

    The leads are read five times at most, each time a few columns: once for each
    table of the cube, once for the call list and once for the remarks.
    """
    cube = report_cube(prepared, rules)
    return report_sections(cube.staged() if staged else cube, prepared, staged)


class ReportBook:
    """Reports over one prepared lead book; every filter is summed from one stored cube.

    Labels are folded once, on the whole book, so a lead carries the same labels
    in every view.
    """

    def __init__(self, leads: DataFrame, rules: list[dict] | None = None):
        self.prepared = stage(prepare_frame(leads), "prepared")
        self.with_rules(rules or [])

    @property
    def cube(self) -> Cube:
        if self._cube is None:
            self._cube = report_cube(self.prepared, self.rules).staged()
        return self._cube

    def report(self, filters: Filters = Filters()) -> Sections:
        if not filters.empty:
            return report_sections(self.cube.sliced(filters), slice_frame(self.prepared, filters, self.rules))
        if self._whole is None:
            self._whole = report_sections(self.cube, self.prepared)
        return self._whole

    def with_rules(self, rules: list[dict]) -> None:
        """Use other rules; the prepared book is kept, only the cube and reports are redone."""
        self.rules = rules
        self._cube: Cube | None = None
        self._whole: Sections | None = None
