from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.operators import headers, notes, sheets, union


def test_alias_table_has_no_double_claims():
    assert len(S.CANONICAL_FIELDS) == 48
    with pytest.raises(ValueError, match="claimed"):
        S.alias_lookup({"a": ("x",), "b": ("x",)})


def test_sheet_headers_number_blanks_and_repeats():
    assert sheet_names(["Form", "", "Form", None, "Form.1"]) == ["Form", "Unnamed: 1", "Form.1", "Unnamed: 3", "Form.1.1"]


def sheet_names(cells):
    return headers.sheet_headers(cells)


def test_canonical_names_and_collisions():
    assert headers.canonical_names(["lead Source", "Mobile", "Phone No", "Whatsapp Number", "Odd"]) == [
        "lead_source", "phone", "phone_2", "phone_3", "Odd",
    ]
    assert headers.canonical_names(["Form", "Form.1", "Facebook Form"]) == ["form", "form_2", "form_3"]


def test_lead_likeness():
    assert not headers.looks_like_leads(["Month", "Target", "Achieved", "Team", "qualitative_remarks"])
    assert headers.looks_like_leads(["name", "phone", "email", "budget", "hwc"])


def test_ensure_canonical_keeps_unknown_columns_in_a_map(spark):
    df = spark.createDataFrame([(1, "A", "x", None)], "row_ord long, name string, odd string, phone_2 string")
    out = headers.ensure_canonical(df)
    assert set(out.columns) == {f.name for f in S.LEAD_ROW_SCHEMA.fields}
    row = out.first()
    assert row["extras"] == {"odd": "x"} and row["name"] == "A" and row["budget"] is None


def test_mapping_then_aliases(spark):
    df = spark.createDataFrame([("A", "9")], "`Cust Nm` string, Mobile string")
    assert headers.normalize_headers(headers.apply_mapping(df, {"Cust Nm": "name"})).columns == ["name", "phone"]


def test_virtual_sheet_names(column):
    name = lambda c: sheets.virtual_sheet(F.lit("S"), c)
    assert column(name, ["A ", "", "NaN", None]) == ["S [A]", "S [No campaign]", "S [No campaign]", "S [No campaign]"]


def test_selection_errors(spark):
    catalogue = spark.createDataFrame(
        [("f", "s", 3, True, None)], "source_file string, source_sheet string, row_count long, looks_like_lead_sheet boolean, detected_type string"
    )
    none = spark.createDataFrame([("f", "s", False, "Plot")], "source_file string, source_sheet string, include boolean, property_type string")
    with pytest.raises(sheets.SelectionError, match="no sheet"):
        sheets.check_selection(sheets.chosen_sheets(catalogue, none))
    untyped = none.withColumns({"include": F.lit(True), "property_type": F.lit(" ")})
    with pytest.raises(sheets.SelectionError, match="no property type"):
        sheets.check_selection(sheets.chosen_sheets(catalogue, untyped))


NOTE = (
    "Campaign: bungalow general_x000D_Full Name: Asha Rao\nCity: Surat\r\nWhat Is Your Budget?: inr_4_cr_to_6_cr\n"
    "Are You Ready (Rs 5L)?: yes,_i_can\ncalled 3 times: no answer"
)


def test_note_pairs(spark):
    df = spark.createDataFrame([(NOTE,), ("no labels here",), (None,)], "t string")
    pairs = [r[0] for r in df.select(notes.note_pairs(F.col("t"))).collect()]
    assert [(p["slug"], p["value"]) for p in pairs[0]] == [
        ("campaign", "bungalow general"), ("fullname", "Asha Rao"), ("city", "Surat"),
        ("whatisyourbudget", "inr_4_cr_to_6_cr"), ("areyoureadyrs5l", "yes,_i_can"), ("called3times", "no answer"),
    ]
    assert not pairs[1] and not pairs[2]


def note_frame(spark, texts):
    rows = [(i, "f", "s", t, None, "real" if i == 0 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "row_ord long, source_file string, source_sheet string, qualitative_remarks string, budget string, current_city string"
    )


def test_labels_recur_or_are_known(spark):
    df = note_frame(spark, ["Timeline: soon", "TimeLine: later\nTimeline: now", "update: not reachable", "Budget: 2_cr"])
    kept = {r["slug"]: (r["rows"], r["label"]) for r in notes.kept_labels(df).collect()}
    assert kept == {"timeline": (2, "Timeline"), "budget": (1, "Budget")}
    assert "update" in {r["slug"] for r in notes.kept_labels(df, proposed=("update",)).collect()}


def test_notes_backfill_and_note_fields(spark):
    df = note_frame(spark, ["City: Surat\nTimeline: 3_months", "City: Surat\nTimeline: x", "City: a: b", "plain"])
    out = {r["row_ord"]: r for r in notes.lift_notes(df).collect()}
    assert out[0]["current_city"] == "real" and out[1]["current_city"] == "Surat"
    assert out[2]["current_city"] == "a: b"
    assert out[0]["note_fields"] == {"note:Timeline": "3 months"} and out[3]["note_fields"] is None


def test_proposed_label_fills_its_field_and_keeps_its_own(spark):
    df = note_frame(spark, ["Spend: 2_cr", "Spend: 3_cr", "x"])
    out = {r["row_ord"]: r for r in notes.lift_notes(df, {"Spend": "budget", "Nope": "salary"}).collect()}
    assert out[0]["budget"] == "2 CR" and out[0]["note_fields"] == {"note:Spend": "2 CR"}


def test_threshold_is_per_sheet(spark):
    rows = [(i, "f", f"s{i % 2}", "Odd: 1" if i in (0, 1) else "x", None, None) for i in range(10)]
    df = spark.createDataFrame(rows, note_frame(spark, []).schema)
    assert notes.kept_labels(df).count() == 0


def test_union_of_nothing(spark):
    empty = union.union_sheets(spark, [])
    assert empty.count() == 0 and "project" in empty.columns
