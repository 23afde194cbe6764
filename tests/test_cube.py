"""The summary cube: slices summed from it equal the sections of the sliced leads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadbook.operators import arrivals, crosstabs, distributions, rules, summaries
from leadbook.operators.cube import build_cube, merge_cubes
from leadbook.operators.filters import Filters, apply_filters, slice_frame
from leadbook.operators.labels import prepare_frame
from leadbook.plans import report as plan
from workload.tables import RULES, lead_book

SF = "/root/testdata/sf0.001"
SLICES = [
    Filters(), Filters(budget_min=2.0, hwc_only=True), Filters(source_file="crm_a.csv", segment="bad"),
    Filters(call_status=("Spoken",), buying_status=("Interested", "Postponed"), segment="good"),
    Filters(segment="hwc", configuration=("4BHK", "Bungalow"), budget_max=9.0), Filters(budget_min=1e6),
]


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def from_leads(frame):
    """The sections worked out from the leads themselves."""
    counts, cells = plan.report_counts(frame), plan.report_cells(frame)
    budgets, arrived = summaries.budget_counts(frame), arrivals.arrival_counts(arrivals.with_stamp(frame))
    configurations = distributions.distribution(counts.filter("field = 'configuration'"))
    return {
        "meta": summaries.report_meta(frame), "data_quality": summaries.data_quality(frame),
        "core": summaries.core_summary(frame), "scope": summaries.report_scope(frame),
        "hwc_split": summaries.hwc_split(frame), "budget": summaries.budget_summary(budgets),
        "budget_bands": summaries.budget_bands(budgets), "distributions": distributions.distribution(counts),
        "crosstabs": crosstabs.crosstab(cells), "coverage": crosstabs.coverage(cells),
        "arrivals": arrivals.arrival_header(arrived), "by_month": arrivals.by_month(arrived),
        "weekday_by_hour": arrivals.weekday_by_hour(arrived), "headline": summaries.headline(frame, budgets, configurations),
        "merge_quality": summaries.merge_quality(frame), "classification": rules.classification_summary(frame),
        "unclassified_reasons": rules.unclassified_reasons(frame), "call_list": summaries.call_list(frame),
    }


@pytest.fixture(scope="module")
def book(spark):
    return plan.ReportBook(lead_book(spark, SF), RULES)


@pytest.mark.parametrize("wanted", SLICES, ids=str)
def test_a_slice_of_the_cube_is_the_slice_of_the_leads(book, wanted):
    report = book.report(wanted)
    expected = from_leads(rules.classify(slice_frame(book.prepared, wanted, RULES), RULES))
    for name, frame in expected.items():
        assert rows(report[name]) == rows(frame), name


def test_summed_sections_read_no_lead(book):
    report = plan.report_sections(book.cube.sliced(Filters(budget_min=1.0)), book.prepared, staged=False)
    held = set(book.prepared.inputFiles())
    reading = {name for name in report if held & set(report[name].inputFiles())}
    assert reading == {"call_list", "remarks"}


def test_five_scans_at_most(book):
    cube = plan.report_cube(book.prepared, RULES)
    report = plan.report_sections(cube, book.prepared, staged=False)
    scans = [cube.totals, cube.values, cube.stamps, report["call_list"], report["remarks"]]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in scans]
    assert all(p.count("FileScan") == 1 for p in plans)
    assert not any("qualitative_remarks" in p for p in plans[1:3])


def test_one_section_plans_no_other(book, monkeypatch):
    made = []
    monkeypatch.setattr(plan, "stage", lambda df, label: made.append(label) or df)
    report = plan.report_sections(book.cube, book.prepared)
    assert len(report) == 27 and made == []
    report["budget"], report["budget_bands"], report["core"]
    assert made == ["report_budgets"]


def test_cubes_merge(spark, book):
    frame = rules.classify(book.prepared, RULES)
    parts = [build_cube(frame.filter(F.pmod(F.xxhash64("phone_normalized"), F.lit(3)) == i)) for i in range(3)]
    together, whole = merge_cubes(parts), build_cube(frame)
    for name in ("totals", "values", "stamps"):
        a, b = getattr(together, name), getattr(whole, name)
        assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_merging_takes_a_column_that_one_cube_lacks(spark):
    old = spark.createDataFrame([("2 Cr", "a.csv")], "budget string, source_file string")
    new = spark.createDataFrame([("3 Cr", "x", 2)], "budget string, call_status string, merged_row_count long")
    both = merge_cubes([build_cube(prepare_frame(df)) for df in (old, new)])
    assert rows(summaries.core_summary(both.totals, "n_leads")) == [(0, 0.0, 2)]
    assert rows(both.merge_quality()) == [(1, 1, 2)]
    assert {r["field"]: r["filled"] for r in both.fill().collect()} == {"budget": 2, "call_status": 1}


@pytest.mark.parametrize("columns", ["budget string", "budget string, date string, source_file string, lead_class string, lead_class_reason string"])
def test_empty_frame(spark, columns):
    frame = prepare_frame(spark.createDataFrame([], columns))
    report = plan.full_report(frame.withColumns({"row_ord": F.lit(1), "qualitative_remarks": F.lit("")}), staged=False)
    assert report["core"].first()["total"] == 0 and report["meta"].first()["quality_rate"] is None
    assert report["distributions"].count() == report["crosstabs"].count() == report["by_hour"].count() == 0
    assert report["by_weekday"].count() == 7 and report["availability"].filter("available").count() == 0


def test_stamp_column_is_chosen_for_the_slice(spark):
    leads = spark.createDataFrame(
        [(1, "a", "2026-07-05 - 19:47", "23-Jun-26", "1 Cr"), (2, "b", "soon", "24-Jun-26", "1 Cr"), (3, "b", None, None, "1 Cr")],
        "row_ord long, source_file string, date string, first_call_date string, budget string",
    )
    frame = prepare_frame(leads)
    cube = build_cube(frame)
    for file in ("a", "b", "none"):
        wanted = Filters(source_file=file)
        direct = arrivals.arrival_counts(arrivals.with_stamp(apply_filters(frame, wanted)))
        assert rows(cube.sliced(wanted).arrivals()) == rows(direct)


def test_hundredths_and_blank_keys_stay_apart(spark):
    frame = prepare_frame(spark.createDataFrame([(None,), ("1.01 Cr",), ("1.02 Cr",), ("1.02 Cr",)], "budget string"))
    cube = build_cube(frame)
    assert cube.totals.count() == 3
    assert cube.sliced(Filters(budget_min=1.015)).budgets().agg(F.sum("n")).first()[0] == 2
