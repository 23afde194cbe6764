"""A summary cube of a prepared frame, from which the sections of any slice are summed.

The cube keeps what the report's filters ask for as keys (property type, file,
configuration, statuses, budget in hundredths, flags, class) and counts of leads
beside them.  A filter narrows the cube as it would narrow the leads, since the
keys carry the names of the frame's columns.  All measures are sums, minima and
maxima, so cubes of two sets of leads merge into the cube of both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.counting import leads
from leadbook.functions.text import clean
from leadbook.functions.timing import parse_timestamp
from leadbook.operators import arrivals, crosstabs, distributions, rules, summaries
from leadbook.operators.filters import Filters, apply_filters
from leadbook.runtime import stage

N = "n_leads"
KEYS = (
    S.PROPERTY_TYPE, S.SOURCE_FILE, "configuration_required", "call_status", "buying_status",
    "budget_value", "budget_bucket", summaries.IS_HWC, summaries.IS_QUALITY, S.LEAD_CLASS,
)
# Charted fields that no filter asks for: field name and column.
LISTED = {"hwc": "hwc", "pages": "facebook_page", "campaigns": "campaign", "ad_sets": "facebook_ad_set"}
REASON = S.LEAD_REASON
FILLED = "filled_"
MERGED, ABSORBED = "n_merged", "n_absorbed"
SOURCE = "stamp_source"


def _measure(name: str) -> Column:
    """How a measure merges, told by its name."""
    merge = {"first_stamp": F.min, "last_stamp": F.max}.get(name, F.sum)
    return merge(name).alias(name)


@dataclass(frozen=True)
class Cube:
    """`totals`: leads per keys with fill and merge counts.  `values`: leads per keys,
    field and value.  `stamps`: leads per keys, stamp column, month, weekday, hour and
    kind of stamp.  A frame without classes or merge counts has no such columns."""

    totals: DataFrame
    values: DataFrame
    stamps: DataFrame

    def map(self, change: Callable[[DataFrame, str], DataFrame]) -> Cube:
        tables = {"totals": self.totals, "values": self.values, "stamps": self.stamps}
        return Cube(**{name: change(table, name) for name, table in tables.items()})

    def staged(self) -> Cube:
        return self.map(lambda table, name: stage(table, f"cube_{name}"))

    def sliced(self, filters: Filters) -> Cube:
        """The cube of the leads that pass the filters and lie in the segment."""
        return self.map(lambda table, _: _in_segment(apply_filters(table, filters), filters.segment))

    @property
    def classified(self) -> bool:
        return S.LEAD_CLASS in self.totals.columns

    @property
    def counts_merges(self) -> bool:
        return MERGED in self.totals.columns

    def counts(self) -> DataFrame:
        """(field, value, count) of all charted fields."""
        t = self.totals
        fields = {f: summaries.column_or_null(t, f) for f in ("call_status", "buying_status")}
        fields["configuration"] = summaries.column_or_null(t, "configuration_required")
        if self.classified:
            fields["lead_class"] = summaries.class_label(t)
        listed = self.values.filter(F.col("field") != REASON).groupBy("field", "value")
        return distributions.field_counts(t, fields, N).unionByName(listed.agg(F.sum(N).alias("count")))

    def cells(self, sections: Callable[[DataFrame], dict[str, tuple[Column, Column]]]) -> DataFrame:
        """Cross-tab cells; `sections` gives the axes as columns of the keys."""
        return crosstabs.crosstab_cells(self.totals, sections(self.totals), N)

    def budgets(self) -> DataFrame:
        return summaries.budget_counts(self.totals, N)

    def arrivals(self) -> DataFrame:
        """`arrival_counts` over the first stamp column that has a readable date in this slice."""
        first = F.min(F.when(F.col("month").isNotNull(), F.col(SOURCE)))
        chosen = self.stamps.agg(F.coalesce(first, F.lit(0)).alias(SOURCE))  # one row
        kept = self.stamps.join(F.broadcast(chosen), SOURCE)
        measures = [F.sum(N).alias("n"), _measure("first_stamp"), _measure("last_stamp")]
        return kept.groupBy("month", "weekday", "hour", "timed").agg(*measures)

    def fill(self) -> DataFrame:
        fields = [c for c in self.totals.columns if c.startswith(FILLED)]
        filled = [F.coalesce(F.sum(c), F.lit(0)).alias(c.removeprefix(FILLED)) for c in fields]
        return summaries.fill_rates(self.totals.agg(leads(counted=N).alias("total"), *filled))

    def merge_quality(self) -> DataFrame:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return self.totals.agg(
            total(N).alias("total_leads"), total(MERGED).alias("merged_leads"), total(ABSORBED).alias("rows_absorbed")
        )

    def reasons(self) -> DataFrame:
        """(reason, count) of the unclassified leads."""
        named = self.values.filter(F.col("field") == REASON)
        return named.groupBy(F.col("value").alias("reason")).agg(F.sum(N).alias("count"))


def _in_segment(table: DataFrame, segment: str | None) -> DataFrame:
    """As `apply_segment`, by the classes that the cube holds; without rules nothing is good or bad."""
    wanted = (segment or "").lower()
    if wanted == "hwc":
        return table.filter(summaries.is_hwc(table))
    if wanted in rules.CATEGORIES:
        return table.filter(F.col(S.LEAD_CLASS) == wanted if S.LEAD_CLASS in table.columns else F.lit(False))
    return table


def build_cube(frame: DataFrame) -> Cube:
    """The cube of a prepared frame, classified or not.

    Each table is one scan of its own columns, combined inside every task before
    the shuffle; an empty frame gives an empty cube.
    """
    flagged = summaries.with_flags(frame)
    keys = [k for k in KEYS if k in flagged.columns]
    return Cube(_totals(flagged, keys), _values(flagged, keys), _stamps(flagged, keys))


def _totals(frame: DataFrame, keys: list[str]) -> DataFrame:
    fields = [f for f in summaries.TRACKED_FIELDS if f in frame.columns]
    measures = [leads().alias(N), *[F.count(clean(F.col(f))).alias(f"{FILLED}{f}") for f in fields]]
    if S.MERGED_COUNT in frame.columns:
        rows = F.coalesce(F.col(S.MERGED_COUNT), F.lit(1))
        measures += [leads(rows > 1).alias(MERGED), F.sum(rows - 1).alias(ABSORBED)]
    return frame.groupBy(*keys).agg(*measures)


def _values(frame: DataFrame, keys: list[str]) -> DataFrame:
    entry = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    entries = [entry(f, clean(summaries.column_or_null(frame, c))) for f, c in LISTED.items()]
    if S.LEAD_CLASS in keys:
        open_leads = F.col(S.LEAD_CLASS) == rules.UNCLASSIFIED
        entries.append(entry(REASON, F.when(open_leads, F.col(S.LEAD_REASON))))
    long = frame.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")
    return long.filter(F.col("value").isNotNull()).groupBy(*keys, "field", "value").agg(leads().alias(N))


def _stamps(frame: DataFrame, keys: list[str]) -> DataFrame:
    present = [c for c in arrivals.STAMP_COLUMNS if c in frame.columns]
    read = [parse_timestamp(F.col(c)) for c in present] or [F.lit(None).cast("timestamp")]
    long = frame.select(*keys, F.posexplode(F.array(*read)).alias(SOURCE, "stamp"))
    return arrivals.arrival_counts(long, (*keys, SOURCE)).withColumnRenamed("n", N)


def merge_cubes(cubes: list[Cube]) -> Cube:
    """The cube of several disjoint sets of leads; a column that one of them lacks is null there."""
    measured = lambda c: c in (N, MERGED, ABSORBED, "first_stamp", "last_stamp") or c.startswith(FILLED)

    def merged(tables: list[DataFrame]) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        keys = [c for c in rows.columns if not measured(c)]
        return rows.groupBy(*keys).agg(*[_measure(c) for c in rows.columns if measured(c)])

    return cubes[0].map(lambda _, name: merged([getattr(cube, name) for cube in cubes]))
