"""Ranks and joins with keys of any share of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadbook.spread import ranked, spread_join


def test_ranks_count_on_over_ranges(spark):
    rows = spark.range(3000).select(F.floor(F.col("id") % 3 / 2).alias("g"), (F.col("id") * 7919 % 3001).alias("v"), F.lit("x").alias("a.b"))
    got = ranked(rows.repartition(13), ["g"], ["v"]).collect()
    for g in (0, 1):
        mine = sorted((r["v"], r["rank"]) for r in got if r["g"] == g)
        assert [k for _, k in mine] == list(range(len(mine)))
    assert len(got) == 3000


def test_ranks_of_nulls_ties_and_nothing(spark):
    rows = spark.createDataFrame([("a", None), ("a", 1), ("a", 1), ("b", 5), ("a", None)], "g string, v int")
    got = ranked(rows, ["g"], ["v"]).collect()
    assert sorted((r["g"], r["rank"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
    assert {r["rank"] for r in got if r["v"] is None} == {0, 1}
    assert ranked(rows.limit(0), ["g"], ["v"]).count() == 0


def test_hot_keys_are_joined_where_their_rows_are(spark):
    hot = spark.range(4000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).cast("long").alias("k"), "id")
    rows = hot.unionByName(spark.createDataFrame([(None, 9000), (123456, 9001)], "k long, id long"))
    table = hot.groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("n"), "k"))
    left = spread_join(rows, table, ["k"], F.col("n"), 4002, "left").collect()
    assert len(left) == 4002 and all(r["name"] == (None if r["id"] >= 9000 else f"n{r['k']}") for r in left)
    assert spread_join(rows, table, ["k"], F.col("n"), 4002).count() == 4000
