"""An upserted book must equal a full rebuild, also after replayed batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.operators import identity as I
from leadbook.plans import book
from leadbook.sources import lead_table, ledger
from leadbook.sources.files import delete_path, names_in, write_json
from leadbook.streaming import intake, upsert
from tests.test_identity import FIELDS, SCHEMA, make_rows, merged_rows


def test_upsert_equals_rebuild_and_survives_replay(spark, tmp_path):
    rows = make_rows(600, seed=11)
    whole = spark.createDataFrame(rows, SCHEMA)
    batches = [whole.filter(f"row_ord % 4 = {i}") for i in (2, 0, 3)] + [whole.filter("row_ord % 4 = 1")]
    root = str(tmp_path / "book")
    for number, batch in enumerate(batches):
        upsert.upsert_leads(batch, number, root)
    expected = merged_rows(I.merge_leads(whole))
    assert merged_rows(upsert.read_book(spark, root)) == expected
    upsert.upsert_leads(batches[1], 1, root)
    assert merged_rows(upsert.read_book(spark, root)) == expected


def test_rows_without_maps_are_stored_once_and_a_lone_run_is_not_merged_again(spark, tmp_path, monkeypatch):
    whole = spark.createDataFrame(make_rows(120, seed=3), SCHEMA).drop(S.EXTRAS, S.NOTE_FIELDS)
    root, staged, merged = str(tmp_path / "book"), [], []
    stage, merge = upsert.stage, upsert.merge_states
    monkeypatch.setattr(upsert, "stage", lambda df, label: staged.append(label) or stage(df, label))
    monkeypatch.setattr(upsert, "merge_states", lambda *given: merged.append(1) or merge(*given))
    upsert.upsert_leads(whole, 0, root)
    assert staged == [] and merged == []
    held = upsert.read_book(spark, root)
    assert staged == ["book_states"] and merged == []
    expected = I.merge_leads(whole)
    assert sorted(map(str, held.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    upsert.upsert_leads(whole.withColumn("row_ord", F.col("row_ord") + 1_000), 1, root)
    assert merged == [] and upsert.read_book(spark, root).count() == held.count() and merged == [1]


def test_untouched_leads_are_carried_over(spark, tmp_path):
    make = lambda i, phone: spark.createDataFrame([(i, "f", "A", phone, None, None)], SCHEMA)
    root = str(tmp_path / "book")
    assert upsert.read_book(spark, root) is None
    upsert.upsert_leads(make(0, "9000000001"), 0, root)
    upsert.upsert_leads(make(1, "9000000002"), 1, root)
    upsert.upsert_leads(make(2, "#REF!"), 2, root)
    book = upsert.read_book(spark, root)
    assert {r[S.PHONE_NORM] for r in book.collect()} == {"9000000001", "9000000002"}


def test_intake_takes_only_new_files(spark, tmp_path):
    folder, root, checkpoint = tmp_path / "in", str(tmp_path / "uploads"), str(tmp_path / "checkpoint")
    folder.mkdir()
    header = {"a.csv": "Name,Phone,Email,Budget,City", "b.csv": "Full Name,Mobile,Email ID,Budget Range,Current City"}
    seen = []
    for name, line in header.items():
        (folder / name).write_text(f"{line}\nAmit,9824039892,a@b.c,2 Cr,{name}\n")
        intake.intake_stream(spark, str(folder), root, checkpoint, then=lambda df, n: seen.append(n)).awaitTermination()
    uploads = lead_table.read_uploads(spark, root)
    assert {(r["upload_id"], r["current_city"]) for r in uploads.collect()} == {
        ("batch-000000000000", "a.csv"), ("batch-000000000001", "b.csv"),
    }
    assert seen == [0, 1]
    assert set(FIELDS) <= set(uploads.columns)


def test_streamed_book_equals_the_pool(spark, tmp_path):
    """Files taken in batch by batch and upserted give the book that a full merge gives, on all columns."""
    folder, root = tmp_path / "in", str(tmp_path / "uploads")
    kept = str(tmp_path / "book")
    folder.mkdir()
    line = "Name,Phone,Email,Budget,City,Remarks"
    files = {
        "b.csv": f"{line}\nAmit,9824039892,,,Pune,\nAmit,9824039893,a@b.c,,Surat,\n",
        "a.csv": f"{line}\nAmit,9824039892,z@b.c,2 Cr,,\n,9824039893,,3 Cr,,\nRita,9824039894,r@b.c,,,x\n",
        "junk.csv": "Month,Target\nJan,1\n",
        "c [x].csv": f"{line}\nAmit,9824039892,,4 Cr,Agra,\nRita,9824039894,,,Goa,\n",
    }
    for name, text in files.items():
        (folder / name).write_text(text)
        upsert_batch = lambda rows, number: upsert.upsert_leads(rows, number, kept)
        intake.intake_stream(spark, str(folder), root, str(tmp_path / "checkpoint"), then=upsert_batch).awaitTermination()
    streamed = upsert.read_book(spark, kept)
    pool = book.combined_pool(lead_table.read_uploads(spark, root))
    same = sorted(set(pool.columns) & set(streamed.columns) - {S.ROW_ORD})
    flat = lambda df: sorted(map(str, df.select(*[F.to_json(c) if t.startswith("map") else c for c, t in df.select(*same).dtypes]).collect()))
    assert {"email", "budget", "current_city", S.MERGED_COUNT, S.MEMBER_FRAMES} <= set(same)
    assert flat(streamed) == flat(pool)
    uploads = [r[0] for r in lead_table.read_uploads(spark, root).select("upload_id").distinct().collect()]
    assert len(uploads) == 3
    for upload in sorted(uploads)[1:]:  # forgetting one leaves what the others merge to
        lead_table.remove_upload(spark, root, upload)
        upsert.forget_upload(spark, upload, kept)
        upsert.forget_upload(spark, "no such upload", kept)
        assert flat(upsert.read_book(spark, kept)) == flat(book.combined_pool(lead_table.read_uploads(spark, root)))


class Stopped(Exception):
    pass


def uploads_of(spark, n, every):
    whole = spark.createDataFrame(make_rows(n, seed=5), SCHEMA).withColumn(S.UPLOAD_ID, F.concat(F.lit("u/ "), F.col("row_ord") % every))
    return whole, [whole.filter(F.col(S.UPLOAD_ID) == f"u/ {k}") for k in range(every)]


def flat(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_a_batch_reads_nothing_that_was_stored(spark, tmp_path, monkeypatch):
    """Runs of earlier batches may even be out of reach; only merging a full level reads them."""
    monkeypatch.setattr(upsert, "RUNS_PER_LEVEL", 4)
    whole, batches = uploads_of(spark, 120, 4)
    root, away = tmp_path / "book", tmp_path / "away"
    for number in range(2):
        upsert.upsert_leads(batches[number], number, str(root))
    (root / "runs").rename(away)
    upsert.upsert_leads(batches[2], 2, str(root))
    for name in names_in(spark, str(away)):
        (away / name).rename(root / "runs" / name)
    upsert.upsert_leads(batches[3], 3, str(root))
    runs = upsert.read_manifest(spark, str(root)).runs
    assert [level for _, level in runs] == [1]  # four runs became one
    assert flat(upsert.read_book(spark, str(root)).drop(S.ROW_ORD)) == flat(I.merge_leads(whole).drop(S.ROW_ORD))


def test_rows_are_rewritten_once_a_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "RUNS_PER_LEVEL", 2)
    root, read = str(tmp_path / "book"), []
    states = upsert._states
    monkeypatch.setattr(upsert, "_states", lambda s, r, runs: read.append(len(runs)) or states(s, r, runs))
    batch = spark.createDataFrame(make_rows(20, seed=1), SCHEMA)
    for number in range(8):
        upsert.upsert_leads(batch.withColumn("row_ord", F.col("row_ord") + 20 * number), number, root)
    manifest = upsert.read_manifest(spark, root)
    assert [level for _, level in manifest.runs] == [3] and manifest.applied == ((0, 7),)
    assert read == [2] * 7  # 4 + 2 + 1 merges of two


def test_forgetting_survives_a_stop_after_every_step(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "RUNS_PER_LEVEL", 2)
    whole, batches = uploads_of(spark, 90, 3)
    root = str(tmp_path / "book")
    for number, batch in enumerate(batches):
        upsert.upsert_leads(batch, number, root)
    everything = flat(upsert.read_book(spark, root))
    left = flat(I.merge_leads(whole.filter(F.col(S.UPLOAD_ID) != "u/ 1")).select(upsert.read_book(spark, root).columns))
    steps = {"n": 0}

    def stopping(fn):
        def run(*args):
            fn(*args)
            steps["n"] += 1
            if steps["n"] == steps["stop"]:
                raise Stopped

        return run

    monkeypatch.setattr(upsert, "write_json", stopping(write_json))
    monkeypatch.setattr(upsert, "delete_path", stopping(delete_path))
    stop, seen = 1, []
    while True:
        steps.update(n=0, stop=stop)
        try:
            upsert.forget_upload(spark, "u/ 1", root)
            break
        except Stopped:
            seen.append(flat(upsert.read_book(spark, root)))  # the commit is the first step: whole before, without it after
            stop = 1
    assert len(seen) >= 3 and all(x == left for x in seen) and left != everything
    assert flat(upsert.read_book(spark, root)) == left
    held = [p.read_bytes() for p in (tmp_path / "book" / "runs").rglob("*.parquet")]
    assert held and not any("run_upload=u%2F 1" in str(p) for p in (tmp_path / "book" / "runs").rglob("*"))
    assert len(names_in(spark, f"{root}/manifest")) <= upsert.KEPT_VERSIONS


def test_an_unfinished_manifest_does_not_count(spark, tmp_path):
    _, batches = uploads_of(spark, 60, 2)
    root = str(tmp_path / "book")
    upsert.upsert_leads(batches[0], 0, root)
    before = flat(upsert.read_book(spark, root))
    (tmp_path / "book" / "manifest" / "000000000002.json").write_text('{"runs": [["batch-')
    assert flat(upsert.read_book(spark, root)) == before
    upsert.upsert_leads(batches[1], 1, root)
    assert upsert.read_manifest(spark, root).applied == ((0, 1),)


def test_ledger_numbers_batches_without_reading_them(spark, tmp_path, monkeypatch):
    folder, root, checkpoint = tmp_path / "in", str(tmp_path / "uploads"), str(tmp_path / "checkpoint")
    folder.mkdir()
    line = "Name,Phone,Email,Budget,City"
    texts = {"a.csv": f"{line}\nA,9824039892,,,\nB,,,,\nA,9824039892,a@b.c,,\n", "junk.csv": "Month\nJan\n", "b.csv": f"{line}\nC,9824039893,,,x\n"}
    monkeypatch.setattr(lead_table, "read_uploads", lambda *a: pytest.fail("a batch read stored uploads"))
    for name, text in texts.items():
        (folder / name).write_text(text)
        intake.intake_stream(spark, str(folder), root, checkpoint).awaitTermination()
    records = {r["upload_id"]: r for r in ledger.read_ledger(spark, root).collect()}
    spans = [(records[k]["status"], records[k]["first_row"], records[k]["next_row"]) for k in sorted(records)]
    assert spans == [("ready", 0, 3), ("empty", 3, 3), ("ready", 3, 4)]
    first = records["batch-000000000000"]
    assert (first["input_rows"], first["unique_leads"], first["missing_phone_dropped"], first["files"]) == (3, 1, 1, "a.csv")
    assert ledger.first_free_row(spark, root, "batch-000000000002") == 3
    assert lead_table.remove_upload(spark, root, "batch-000000000000") and not lead_table.remove_upload(spark, root, "batch-000000000000")
    assert [r["upload_id"] for r in ledger.listed_uploads(spark, root).collect()] == ["batch-000000000002"]
    assert ledger.read_ledger(spark, str(tmp_path / "none")).count() == 0
