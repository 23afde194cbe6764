"""Report invariants on derived leads, and small hand-checked sections."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadbook.operators import arrivals, catalogue, crosstabs, distributions, export, headers, summaries
from leadbook.operators.filters import Filters, apply_filters, apply_segment, value_list
from leadbook.operators.labels import case_variants, fold_case, prepare_frame
from leadbook.plans.report import ReportBook
from workload.tables import RULES, lead_book

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def book(spark):
    return ReportBook(lead_book(spark, SF), RULES)


@pytest.fixture(scope="module")
def report(book):
    return book.report()


def test_cross_tabs_add_up(report):
    counted = {r["section"]: r for r in report["coverage"].collect()}
    sums = {r[0]: r[1] for r in report["crosstabs"].groupBy("section").agg(F.sum("n")).collect()}
    charted = {r[0]: r[1] for r in report["chart_matrices"].groupBy("section").agg(F.sum("n")).collect()}
    total = report["meta"].first()["total_leads"]
    for section, row in counted.items():
        assert row["total"] == total
        assert sums.get(section, 0) == charted.get(section, 0) == row["counted"]


def test_classes_add_up(report):
    row = report["classification"].first()
    assert row["good"] + row["bad"] + row["unclassified"] == row["total"]


def test_grids_are_dense(report):
    assert report["by_weekday"].count() == 7 and report["by_hour"].count() == 24
    assert report["weekday_by_hour"].count() == 168
    dated = report["arrivals"].first()
    assert report["by_weekday"].agg(F.sum("count")).first()[0] == dated["dated_leads"]
    assert report["by_hour"].agg(F.sum("count")).first()[0] == dated["timed_leads"]


def test_labels_agree_between_the_book_and_a_slice(book):
    whole = {r[0] for r in book.report()["distributions"].filter("field = 'configuration'").select("value").collect()}
    part = book.report(Filters(hwc_only=True))["distributions"].filter("field = 'configuration'")
    assert {r[0] for r in part.select("value").collect()} <= whole
    assert book.report() is book.report()


def test_changed_rules_redo_the_report(book, report):
    book.with_rules([])
    assert "classification" not in book.report() and "classification" in report
    book.with_rules(RULES)


def test_top_k_needs_no_full_sort(book):
    plan = summaries.call_list(book.prepared)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_sections_read_few_columns(book):
    plan = summaries.budget_counts(book.prepared)._jdf.queryExecution().executedPlan().toString()
    assert "budget_value" in plan and "qualitative_remarks" not in plan


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, "Call Back", "2 Cr", "3 BHK", "VIP"), (2, "call back", "80 L", "4bhk", None), (3, "call back ", None, "Villa", "-"),
        (4, "Zed", "9 Cr", "villa, 3BHK", None), (5, "N/A", "x", None, None),
    ]
    return spark.createDataFrame(rows, "row_ord long, call_status string, budget string, configuration_required string, hwc string")


def test_usual_spelling_wins(small):
    variants = {tuple(r) for r in case_variants(small, ("call_status",)).collect()}
    assert variants == {("call_status", "Call Back", "call back")}
    assert [r[0] for r in fold_case(small).orderBy("row_ord").select("call_status").collect()] == ["call back"] * 3 + ["Zed", None]


def test_prepared_frame_order(small):
    out = prepare_frame(small).orderBy("row_ord").collect()
    assert [r["configuration_required"] for r in out] == ["3BHK", "4BHK", "Bungalow", "Bungalow, 3BHK", None]
    assert [r["budget_bucket"] for r in out] == ["2–3 Cr", "< 1 Cr", None, "7–10 Cr", None]


def test_budget_section(small):
    counts = summaries.budget_counts(prepare_frame(small))
    row = summaries.budget_summary(counts).first()
    assert (row["parsed_count"], row["unparsed_count"], row["min"], row["max"], row["median"], row["mean"]) == (3, 2, 0.8, 9.0, 2.0, 3.93)
    empty = summaries.budget_summary(summaries.budget_counts(prepare_frame(small).limit(0))).first()
    assert empty["total_rows"] == 0 and empty["median"] is None


def test_filters(small):
    frame = prepare_frame(small)
    assert apply_filters(frame, Filters(budget_min=1.0)).count() == 2
    assert apply_filters(frame, Filters(configuration=("Bungalow, 3BHK",))).count() == 1
    assert apply_filters(frame, Filters(hwc_only=True)).count() == 1
    assert apply_segment(frame, "good", []).count() == 0
    assert apply_segment(frame, "anything", []).count() == 5
    assert value_list("a, b,,") == ("a", "b") and value_list(["4BHK, 5BHK"]) == ("4BHK, 5BHK",) and value_list(None) == ()


def test_folds(spark):
    values = spark.range(100).select(F.concat(F.lit("v"), F.expr("least(id div 9, 10)")).alias("v"), (F.col("id") % 14).alias("r"))
    counts = distributions.field_counts(values, {"v": F.col("v")})
    slices = distributions.fold_slices(counts).collect()
    assert len(slices) == 8 and slices[-1]["label"] == "Other" and slices[-1]["folded"] == 4
    assert sum(s["count"] for s in slices) == 100
    eight = distributions.fold_slices(distributions.field_counts(values.filter("v < 'v8' AND v <> 'v10'"), {"v": F.col("v")}))
    assert eight.count() == 8 and eight.filter("label = 'Other'").count() == 0
    matrix = crosstabs.fold_matrix(crosstabs.crosstab_cells(values, {"s": (F.col("r").cast("string"), F.col("v"))}))
    assert matrix.count() == 11 * 8
    assert matrix.agg(F.sum("n")).first()[0] == 100
    assert matrix.filter("row_label = 'Other (4 categories)'").count() == 8


def test_hours_are_withheld_below_the_gate(spark):
    few = spark.createDataFrame([("2026-07-05 - 19:47",), ("23-Jun-26",)], "date string")
    counts = arrivals.arrival_counts(arrivals.with_stamp(few))
    assert arrivals.by_hour(counts).count() == 0 and arrivals.weekday_by_hour(counts).count() == 0
    assert [r["kind"] for r in arrivals.peaks(counts).collect()] == ["weekday"]
    none = arrivals.with_stamp(few.withColumn("date", F.lit("soon")))
    assert not arrivals.arrival_header(arrivals.arrival_counts(none)).first()["available"]


def test_field_catalogue_leaves_out_long_fields(spark):
    df = spark.range(1000).select(
        F.col("id").alias("row_ord"), F.concat(F.lit("x"), "id").alias("many"), F.when(F.col("id") % 4 == 0, F.lit("a")).alias("few"),
        F.lit(None).cast("string").alias("none"), F.lit("n").alias("name"),
        F.create_map(F.lit("note:T"), (F.col("id") % 3).cast("string")).alias("note_fields"),
    )
    rows = {r["field"]: r for r in catalogue.field_catalogue(df).collect()}
    assert set(rows) == {"few", "note:T"}
    assert rows["few"]["fill_rate"] == 0.25 and rows["note:T"]["values"] == ["0", "1", "2"]
    assert rows["note:T"]["label"] == "T  (from notes)" and rows["note:T"]["from_notes"]


def test_export_columns(spark):
    df = spark.createDataFrame([("a", 1.0, "good", "why")], "name string, budget_value double, lead_class string, lead_class_reason string")
    assert export.export_rows(df).columns == ["name", "lead_class", "lead_class_reason"]
    assert export.export_rows(df, ["zz"]).columns == ["name", "lead_class", "lead_class_reason"]
    assert export.export_rows(df, ["lead_class_reason", "name"]).columns == ["lead_class_reason", "name"]
    with pytest.raises(ValueError):
        export.class_slice(df, [], "ugly")


def test_audience_uses_second_phone_and_drops_unreachable(spark):
    df = spark.createDataFrame(
        [("𝑹𝒂𝒏𝒋𝒊𝒕 Shah", None, {"phone_2": "9824039892"}, " A@B.c ", "2 Cr"), ("999", None, None, None, None)],
        "name string, phone string, extras map<string,string>, email string, budget string",
    )
    rows = export.ad_audience(df.withColumn("phone", F.lit(" "))).collect()
    assert [tuple(r) for r in rows] == [("a@b.c", "+919824039892", "Ranjit", "Shah", "", "", "IN", "20000000", "INR")]


def test_column_sample_takes_fullest_rows(spark):
    df = spark.range(50).select("id", F.when(F.col("id") >= 40, F.lit("x" * 80)).alias("a"), F.lit("b").alias("b"))
    sample = headers.column_sample(df, "id", ["a", "b"]).collect()
    assert sum(r["column_name"] == "a" for r in sample) == 10 and all(len(r["value"]) <= 60 for r in sample)
