"""Embedding near-dedup: spherical k-means cells and blocked cosine products inside them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.llm.components import components
from leadbook.runtime import stage

# Rows of the sample that fits the centroids, on the driver; every row is assigned and compared.
SAMPLE_ROWS = 20_000
# Vectors that a cell should have; the sample bounds the number of cells to one for SAMPLE_PER_CELL of its rows.
CELL_ROWS = 2_000
SAMPLE_PER_CELL = 16
KMEANS_ROUNDS = 12
# Vectors of a block; a pair of blocks is one task's matrix product.
BLOCK_ROWS = 2_048
# Placed rows of one output batch: a vector has a row for each cell that it visits.
PLACED_ROWS = 20_000


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means on unit vectors, from a fixed seed."""
    rng = np.random.default_rng(0)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, np.float64) for v in vectors])
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)  # no overflow in the squares
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def usable(vector: str):
    """Not null, not empty, without null or non-finite components, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _places(centroids: dict[int, np.ndarray], threshold: float):
    """Cells of each vector: its home, and those of higher number that can hold a linked vector.

    Let v be nearer to centroid c than to d by a = v.(c - d), and u in the cell of d at an angle
    t to v.  From u = cos t v + sin t w with w at a right angle to v, and u.(c - d) <= 0, follows
    a <= sin t |c - d|: no linked vector is in the cells that fail this.
    """
    sine = math.sqrt(max(0.0, 1 - threshold**2))
    reach, first = {}, 0
    for dim, c in sorted(centroids.items()):
        apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 512 else None
        reach[dim] = (c, apart, first)
        first += len(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                c, apart, base = reach[dim]
                near = unit_rows(part["vector"]) @ c.T
                home = near.argmax(1)
                ahead = near[np.arange(len(near)), home][:, None] - near
                gaps = apart[home] if apart is not None else np.stack([np.linalg.norm(c - c[h], axis=1) for h in home])
                visits = (ahead <= sine * gaps + 1e-9) & (np.arange(len(c))[None, :] > home[:, None])
                visits[np.arange(len(near)), home] = True
                row, cell = np.nonzero(visits)
                for k in range(0, len(row), PLACED_ROWS):
                    own, at = row[k : k + PLACED_ROWS], cell[k : k + PLACED_ROWS]
                    out = part.iloc[own][["node", "weight", "vector"]]
                    yield out.assign(cell=at + base, visitor=at != home[own])

    return run


def _compare(threshold: float):
    """Link counts and a star per component within one pair of blocks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        same = bool(group["same"].iloc[0])
        if same:
            left = right = group
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "other": [], "links": []}).astype("int64")
        a, b = unit_rows(left["vector"]), unit_rows(right["vector"])
        linked = a @ b.T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        links_a, links_b = linked @ right["weight"].to_numpy(), left["weight"].to_numpy() @ linked
        rows, cols = np.flatnonzero(links_a), np.flatnonzero(links_b)
        linked = linked[np.ix_(rows, cols)]
        name_a, name_b = left["node"].to_numpy()[rows], right["node"].to_numpy()[cols]
        star_a, star_b = name_a.copy(), name_b.copy()
        far = np.iinfo(np.int64).max
        while len(rows):  # the smallest node spreads over each component
            new_a = np.minimum(star_a, np.where(linked, star_b[None, :], far).min(1))
            new_b = np.minimum(star_b, np.where(linked, new_a[:, None], far).min(0))
            if (new_a == star_a).all() and (new_b == star_b).all():
                break
            star_a, star_b = new_a, new_b
        out = pd.DataFrame({"node": name_a, "other": star_a, "links": links_a[rows]})
        if not same:
            out = pd.concat([out, pd.DataFrame({"node": name_b, "other": star_b, "links": links_b[cols]})])
        return out

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Link vectors (vec_id, embedding) with a cosine of at least `threshold`.

    Returns per row vec_id, n_links (other rows linked directly), component_id (the smallest
    vec_id reachable by links) and kept (vec_id = component_id).  Every cosine is taken in
    double precision, so no pair below the threshold links.  Equal vectors are one node with a
    weight.  A vector is compared with all of its cell and with every cell that can hold a linked
    vector, so no link is missed.  Tables that fill one cell are compared whole.  Vectors of different length never link.  Null or
    zero vectors and those with null or non-finite components have no links and lead themselves.
    A repeated vec_id is as many rows; null vec_ids lead only among themselves; an empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("fit", usable("vector"))
    rows = stage(rows.withColumn("vector", F.when(F.col("fit"), F.col("vector"))), "vectors")
    good = rows.where("fit")
    nodes = stage(good.groupBy("vector").agg(F.min("uid").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("lead")), "nodes")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    links, stars = None, None
    if sizes:
        sample = nodes.select("vector").orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).toPandas()["vector"]
        centroids = {}
        for dim, n in sizes.items():
            own = sample[sample.map(len) == dim]
            cells = min(-(-n // CELL_ROWS), max(1, len(own) // SAMPLE_PER_CELL))
            centroids[dim] = fit_centroids(unit_rows(own), cells) if len(own) else np.eye(1, dim)
        found = _linked(spark, nodes, centroids, threshold)
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        stars = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    return _labelled(rows, nodes, links, stars)


def _linked(spark, nodes: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    schema = "node long, weight long, vector array<float>, cell long, visitor boolean"
    placed = stage(nodes.select("node", "weight", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(_places(centroids, threshold), schema), "cells")
    counts = placed.groupBy("cell", "visitor").agg(F.count("*").alias("n"))
    blocks = counts.groupBy("cell").agg(
        F.ceil(F.sum(F.when(~F.col("visitor"), F.col("n")).otherwise(0)) / BLOCK_ROWS).cast("int").alias("homes"),
        F.ceil(F.sum(F.when(F.col("visitor"), F.col("n")).otherwise(0)) / BLOCK_ROWS).cast("int").alias("guests"),
    )
    cut = placed.join(F.broadcast(blocks), "cell")  # one row per cell, at most SAMPLE_ROWS / SAMPLE_PER_CELL
    cut = cut.where("homes > 0")
    block = F.pmod(F.xxhash64("node"), F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    cut = cut.withColumn("block", block)
    # a home block meets the home blocks from itself on and all guest blocks; pairs are (left, right, left is guests)
    meets_home = F.transform(
        F.sequence(F.lit(0), F.col("homes") - 1),
        lambda j: F.struct(F.least("block", j).alias("l"), F.greatest("block", j).alias("r"), F.lit(False).alias("g"),
                           F.when(F.col("block") <= j, 0).otherwise(1).alias("side"), (F.col("block") == j).alias("same")),
    )
    guest_blocks = F.when(F.col("guests") > 0, F.sequence(F.lit(0), F.greatest(F.col("guests") - 1, F.lit(0))))
    meets_guest = F.transform(
        F.coalesce(guest_blocks, F.array().cast("array<int>")),
        lambda j: F.struct(j.alias("l"), F.col("block").alias("r"), F.lit(True).alias("g"), F.lit(1).alias("side"), F.lit(False).alias("same")),
    )
    visits = F.transform(
        F.sequence(F.lit(0), F.col("homes") - 1),
        lambda j: F.struct(F.col("block").alias("l"), j.alias("r"), F.lit(True).alias("g"), F.lit(0).alias("side"), F.lit(False).alias("same")),
    )
    pairs = F.when(F.col("visitor"), visits).otherwise(F.concat(meets_home, meets_guest))
    dealt = cut.withColumn("pair", F.explode(pairs)).select("cell", "pair.*", "node", "weight", "vector")
    return stage(dealt.groupBy("cell", "g", "l", "r").applyInPandas(_compare(threshold), "node long, other long, links long"), "linked")


def _labelled(rows: DataFrame, nodes: DataFrame, links: DataFrame | None, stars: DataFrame | None) -> DataFrame:
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    rooted = nodes.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    leads = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    labels = rooted.join(leads, "root").join(links, "node", "left")
    labels = stage(labels.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), "component_id"), "vector-labels")
    joined = rows.where("fit").join(labels, "vector").select("vec_id", "n", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select(
        "vec_id",
        F.col("n").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
