"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.runtime import discard, stage


def _signature(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to one row (node, root) per linked node; root is its component's smallest node.

    Each round points every node's larger neighbours, then its smaller ones, at the
    smallest it sees; the table never grows beyond one row per link and node, and
    the rounds grow with the logarithm of the longest path.  Rounds are staged in
    the shared folder; links never reach the driver.  No links give no rows.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stage(links.where("a <> b").select(a, b).distinct(), "links")
    seen = _signature(edges)
    if not seen[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = large.join(lowest, "a").select(pairs.alias("e")).select("e.*").where("a <> b").distinct()
        before, edges = edges, stage(small, "stars")
        discard(before)
        now = _signature(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
