"""Size-checked lookups: the broadcast and the salted way must agree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadbook import runtime
from leadbook.operators import labels, notes, sheets


@pytest.fixture
def tables(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("row_ord"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
    )
    lookup = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)]], "k string, v int")
    return rows, lookup


def snapshot(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_small_copy_is_bounded(spark, monkeypatch):
    table = spark.createDataFrame([("a", "x" * 10), ("b", None)], "k string, v string")
    assert snapshot(runtime.small_copy(table)) == snapshot(table)
    assert runtime.small_copy(table.limit(0)).count() == 0
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 1)
    assert runtime.small_copy(table) is None
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(runtime, "BROADCAST_ROW_BYTES", 5)
    assert runtime.small_copy(table) is None


def test_both_lookups_agree(tables, monkeypatch):
    rows, lookup = tables
    broadcast = runtime.lookup_join(rows, lookup, ["k"], "row_ord")
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    salted = runtime.lookup_join(rows, lookup, ["k"], "row_ord")
    assert snapshot(salted) == snapshot(broadcast)
    assert salted.count() == rows.count()


def test_operators_are_the_same_without_broadcast(spark, monkeypatch):
    rows = [(i, f"f{i % 3}", f"s{i % 2}", "Odd: a_b\nCity: X" if i % 2 else "x", None, None, ["Call Back", "call back", "CALL BACK"][i % 3 if i % 5 else 0]) for i in range(90)]
    df = spark.createDataFrame(
        rows, "row_ord long, source_file string, source_sheet string, qualitative_remarks string, budget string, current_city string, call_status string"
    )
    catalogue = sheets.sheet_catalogue(df, matched=6)
    choices = catalogue.select("source_file", "source_sheet", F.lit(True).alias("include"), F.lit("Plot").alias("property_type"))

    def run():
        lifted = notes.lift_notes(df).withColumn("note_fields", F.to_json("note_fields"))
        kept = sheets.keep_chosen(df, sheets.chosen_sheets(catalogue, choices))
        return snapshot(lifted), snapshot(labels.fold_case(df)), snapshot(kept)

    small = run()
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    assert run() == small


def test_scratch_root_comes_from_the_session(spark):
    root = runtime.scratch_root(spark)
    assert spark.conf.get("spark.checkpoint.dir") == root
    assert runtime.scratch_path(spark, "x").startswith(root)


def test_staged_frame_is_pruned(spark):
    staged = runtime.stage(spark.range(10).selectExpr("id", "id * 2 AS twice", "'a' AS c"), "pruned")
    plan = staged.filter("id > 3").select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan
    assert "ReadSchema: struct<id:bigint,twice:bigint>" in plan


def test_discarded_tables_are_gone(spark):
    table = runtime.stage(spark.range(5), "short_lived")
    path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_path)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(path)
    runtime.discard(table, spark.range(3), None)
    assert not store.exists(path)


def test_rows_per_file_bounds_the_files(spark):
    table = runtime.stage(spark.range(0, 100, 1, 1), "cut", rows_per_file=30)
    assert len(table.inputFiles()) == 4 and table.count() == 100
