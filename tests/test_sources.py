from __future__ import annotations

from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.operators import export
from leadbook.operators.notes import lift_notes
from leadbook.plans import book
from leadbook.sources import exports, lead_table
from leadbook.streaming import intake


def put(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


def test_csv_dirt(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "Flat Leads.csv", "Name,Phone,Form,,Form,Budget,Odd\nAmit,9824039892,f1,x,f2,\"1 Cr\nor 2\",o\n,,,,,,\nNaN,NA,,,,n/a,\n")
    put(folder, "café.csv", "Full Name,Mobile,City,Email\nJosé,9824039893,São,a@b.c\n", "latin-1")
    put(folder, "bom.csv", "﻿Name,Phone\r\nA â‚¹80,1\r\nB,2\r\n")
    put(folder, "empty.csv", "\n\n")
    put(folder, "broken header.csv", "Name,Phone,\"Budget\nRange\",City\nMulti,9824039894,\"3 Cr, or\nmore\",Pune\n")
    rows, matches = exports.read_exports(spark, str(folder))
    got = {r["row_ord"]: r for r in rows.collect()}
    assert sorted(got) == list(range(len(got)))
    by_name = {r["name"]: r for r in got.values()}
    amit = by_name["Amit"]
    assert (amit["form"], amit["form_2"], amit["budget"]) == ("f1", "f2", "1 Cr\nor 2")
    assert amit["extras"] == {"Unnamed: 3": "x", "Odd": "o"}
    assert amit["source_file"] == "Flat Leads.csv"
    assert by_name["José"]["current_city"] == "São" and by_name["José"]["source_file"] == "café.csv"
    assert (by_name["Multi"]["budget"], by_name["Multi"]["current_city"]) == ("3 Cr, or\nmore", "Pune")
    assert "A ₹80" in by_name and len(got) == 5
    assert {r[0]: r[1] for r in matches.collect()}["Flat Leads.csv"] == 5


def test_row_order_follows_files_and_rows(spark, tmp_path):
    folder = tmp_path / "in"
    for f in range(5):
        header = "Name,Phone" if f % 2 else "Full Name,Mobile"
        put(folder, f"f{f}.csv", header + "\n" + "".join(f"n{f}-{i},9\n" for i in range(200)))
    rows, _ = exports.read_exports(spark, str(folder))
    names = [r["name"] for r in rows.orderBy(S.ROW_ORD).collect()]
    assert names == [f"n{f}-{i}" for f in range(5) for i in range(200)]
    split, _ = exports.read_exports(spark, str(folder))
    assert [r["name"] for r in split.orderBy(S.ROW_ORD).collect()] == names


def test_draft_to_lead_rows(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "export.csv", "Name,Phone,Email,Budget,Campaign,Remarks\n" + "".join(
        f"P{i},98240398{i:02d},p{i}@x.com,2 Cr,{'Villa push' if i % 2 else ''},Timeline: {i}_days\n" for i in range(8)))
    put(folder, "targets.csv", "Month,Target\nJan,1\nFeb,2\n")
    draft = book.read_draft(spark, str(folder))
    catalogue = {r["source_sheet"]: r for r in draft.catalogue.collect()}
    assert catalogue["export.csv [Villa push]"]["detected_type"] == "Bungalow"
    assert catalogue["export.csv [No campaign]"]["detected_type"] is None
    assert not catalogue["targets.csv"]["looks_like_lead_sheet"]  # a file without a campaign column stays whole
    rows = book.confirm(draft, book.detected_choices(draft.catalogue))
    assert rows.count() == 8
    types = {r[0]: r[1] for r in rows.groupBy("property_type").count().collect()}
    assert types == {"Bungalow": 4, "Mixed / Other": 4}
    assert rows.filter("note_fields['note:Timeline'] = '3 days'").count() == 1
    assert book.build_lead_book(rows).count() == 8


def test_cells_beyond_the_header_are_kept(spark, tmp_path):
    put(tmp_path / "in", "wide.csv", 'Name,Phone,City\nA,1,X,EXTRA,"V, ""I"" P"\nB,2\nC,3,Y,\n,,,only\n')
    rows, _ = exports.read_exports(spark, str(tmp_path / "in"))
    got = {r["name"]: r["extras"] for r in rows.collect()}
    assert got["A"] == {"Unnamed: 3": "EXTRA", "Unnamed: 4": 'V, "I" P'}
    assert got[None] == {"Unnamed: 3": "only"}
    assert not got["B"] and not got["C"] and len(got) == 4


def test_any_file_name(spark, tmp_path):
    for name in ("leads [may].csv", "a{b}.csv", "what?.csv", "st*r.csv", "100% +x.csv"):
        put(tmp_path / "in", name, f"Name,Phone\n{name},9\n")
    rows, _ = exports.read_exports(spark, str(tmp_path / "in"))
    assert all(r["name"] == r["source_file"] for r in rows.collect()) and rows.count() == 5


def test_exported_note_and_extra_fields(spark):
    df = spark.createDataFrame([("A", {"Odd": "o"}, {"note:Timeline": "3 days"}), ("B", None, None)], "name string, extras map<string,string>, note_fields map<string,string>")
    rows = export.export_rows(df, ["note:Timeline", "name", "Odd"]).collect()
    assert [tuple(r) for r in rows] == [("3 days", "A", "o"), (None, "B", None)]
    assert export.export_rows(df, ["name", "nowhere"]).columns == ["name", "nowhere"]


def test_protected_fields_are_not_filled_from_notes(spark):
    rows = [(i, "f", "s", f"Alt: 982403989{i}\nPlace: P{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "row_ord long, source_file string, source_sheet string, qualitative_remarks string")
    lifted = lift_notes(df.withColumn("phone", F.lit(None).cast("string")), {"Alt": "phone", "Place": "current_city"})
    assert [(r["phone"], r["current_city"]) for r in lifted.orderBy("row_ord").collect()] == [(None, f"P{i}") for i in range(4)]


def test_proposals_reach_the_draft(spark, tmp_path):
    put(tmp_path / "in", "new.csv", "Cust,Mob No,Mail To,Town,Wants\n" + "Amit,9824039892,a@b.c,Pune,3 BHK\n" * 3)
    put(tmp_path / "in", "known.csv", "Name,Phone,Email,Budget,City\nB,2,x,1 Cr,Y\n")
    folder = str(tmp_path / "in")
    draft = book.read_draft(spark, folder)
    wanted = {r["source_file"]: (r["column_count"], r["wants_proposal"]) for r in draft.catalogue.collect()}
    assert wanted == {"new.csv": (5, True), "known.csv": (5, False)}
    rows = [("new.csv", "Cust", "name", 1), ("new.csv", "Town", "name", 2), ("new.csv", "Mob No", "phone", 3), ("new.csv", "Nope", "email", 4),
            ("new.csv", "Wants", "salary", 5), ("known.csv", "Name", "email", 6)]
    proposals = spark.createDataFrame(rows, "source_file string, source_col string, target_field string, ord int")
    mappings = book.accepted_proposals(draft, proposals)
    assert mappings == {"new.csv": {"Cust": "name", "Mob No": "phone", "Nope": "email"}}
    again = book.read_draft(spark, folder, mappings)
    matched = {r["source_file"]: r["matched_fields"] for r in again.catalogue.collect()}
    assert matched["new.csv"] == 2 and matched["known.csv"] == 5
    assert again.rows.filter("source_file = 'new.csv'").first()["name"] == "Amit"


def test_mapping_per_file(spark, tmp_path):
    put(tmp_path / "in", "new.csv", "Cust,Mob No,City\nAmit,9824039892,X\n")
    rows, matches = exports.read_exports(spark, str(tmp_path / "in"), {"new.csv": {"Cust": "name", "Mob No": "phone"}})
    assert rows.first()["name"] == "Amit" and matches.first()["matched_fields"] == 3


def test_uploads_can_be_replaced_and_removed(spark, tmp_path):
    root = str(tmp_path / "uploads")
    df = spark.createDataFrame([(0, "f", "A", "9824039892")], "row_ord long, source_file string, name string, phone string")
    for upload in ("u1", "u2"):
        lead_table.write_upload(df, root, upload, "2026")
    lead_table.write_upload(df.union(df), root, "u1", "2027")
    assert lead_table.read_uploads(spark, root).count() == 3
    pool = book.combined_pool(lead_table.read_uploads(spark, root)).first()
    assert (pool[S.MERGED_COUNT], pool[S.MEMBER_FRAMES]) == (3, 2)
    assert lead_table.remove_upload(spark, root, "u1")
    assert lead_table.read_uploads(spark, root).count() == 1


def test_pool_prefers_earlier_uploads(spark, tmp_path):
    root = str(tmp_path / "uploads")
    make = lambda budget: spark.createDataFrame([(0, "f", "A", "9824039892", budget)], "row_ord long, source_file string, name string, phone string, budget string")
    lead_table.write_upload(make("late"), root, "u1", "2026-02")
    lead_table.write_upload(make("early"), root, "u2", "2026-01")
    assert book.combined_pool(lead_table.read_uploads(spark, root)).first()["budget"] == "early"


def test_export_csv_flattens_maps(spark, tmp_path):
    df = spark.createDataFrame([("a", {"k": "v"}, "good")], "n string, m map<string,string>, lead_class string")
    lead_table.write_export(df, str(tmp_path / "out"), partition_by=("lead_class",))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert back["m"] == '{"k":"v"}' and back["lead_class"] == "good"


def test_harmonise_makes_text(spark):
    df = spark.createDataFrame([(1, 2.5, True)], "row_ord long, kids double, flag boolean")
    assert dict(exports.harmonise(df).dtypes) == {"row_ord": "bigint", "kids": "string", "flag": "string"}
    assert df.select(F.col("kids")).first()[0] == 2.5


def test_uploads_with_and_without_keys_make_one_pool(spark, tmp_path):
    """Intake stores rows with their keys; uploads stored without them lose no row beside those."""
    folder, root = tmp_path / "in", str(tmp_path / "uploads")
    folder.mkdir()
    (folder / "f.csv").write_text("Name,Phone,Email,Budget,Configuration\nAmit,9824039892,a@x.com,2 Cr,3 BHK\nBad,12,b@x.com,,\n")
    assert intake.take_in(spark, [str(folder / "f.csv")], root, "u2", "2026-02").columns.count("phone_status") == 1
    old = spark.createDataFrame([(0, "f", "Priya", "+91 9824039893"), (1, "f", "Amit", "9824039892")], "row_ord long, source_file string, name string, phone string")
    lead_table.write_upload(old, root, "u1", "2026-01")
    stored = lead_table.read_uploads(spark, root)
    assert sorted((r["name"], r["phone_status"], r["name_key"]) for r in stored.collect()) == [
        ("Amit", "valid", "amit"), ("Amit", "valid", "amit"), ("Bad", "invalid", "bad"), ("Priya", "valid", "priya")
    ]
    pool = {r["phone_normalized"]: r["merged_row_count"] for r in book.combined_pool(stored).collect()}
    assert pool == {"9824039892": 2, "9824039893": 1}
