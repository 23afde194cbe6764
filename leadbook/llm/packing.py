"""Best-fit packing of tokenized documents by a grouping genetic algorithm.

Pieces are dealt by hash to shards of bounded size.  Every shard is packed by
several islands, each a population of groupings in a task of its own; after each
epoch an island sends its elite grouping to the next one of the shard.  The best
grouping of a shard wins.  Its emptiest sequences are released and packed again
with those of other shards, level by level, until one shard is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.llm.tokenizing import encoder
from leadbook.runtime import stage

CAPACITY = 2048
SHARD_ITEMS = 8192
ISLANDS = 3
EPOCHS = 2
POPULATION = 6
GENERATIONS = 6
RELEASED_BINS = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = "shard long, island int, migrant boolean, uids binary, sizes binary, groupings binary"


# --- one island -----------------------------------------------------------------


class Fill:
    """Open sequences by the room left; the tightest fit is found by one bit scan."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, bin_: list[int], room: int) -> None:
        self.rooms[room].append(bin_)
        self.mask |= 1 << room

    def place(self, item: int, size: int) -> list[int] | None:
        """Put the item into the sequence it fills best; the new sequence, if one is opened."""
        fits = self.mask >> size
        if not fits:
            self.add(bin_ := [item], self.capacity - size)
            return bin_
        room = size + (fits & -fits).bit_length() - 1
        bin_ = self.rooms[room].pop()
        if not self.rooms[room]:
            self.mask ^= 1 << room
        bin_.append(item)
        self.add(bin_, room - size)
        return None


def fills(bins: list[list[int]], sizes: list[int]) -> list[int]:
    """The tokens in each sequence."""
    size = sizes.__getitem__
    return [sum(map(size, b)) for b in bins]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Best-fit the items, in the order given, into copies of `bins` and new sequences."""
    bins, fill = [list(b) for b in bins or []], Fill(capacity)
    for b, used in zip(bins, fills(bins, sizes)):
        fill.add(b, capacity - used)
    for i in items:
        opened = fill.place(i, sizes[i])
        if opened is not None:
            bins.append(opened)
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones (sum of squared fills); smaller is better."""
    return len(bins), -sum((used / capacity) ** 2 for used in fills(bins, sizes))


def cross(first: list[list[int]], second: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator):
    """Inject well-filled sequences of `second` whole into `first`; best-fit what they displace."""
    used = np.array(fills(second, sizes))
    good = np.flatnonzero(used >= np.median(used))
    chosen = rng.choice(good, max(1, len(good) // 2), replace=False)
    injected = [second[k] for k in chosen]
    taken = {i for b in injected for i in b}
    kept, displaced = list(injected), []
    for b in first:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit(sorted(displaced, key=lambda i: -sizes[i]), sizes, capacity, kept)


def shake(bins: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator):
    """Empty the least filled sequences and a few others, and best-fit their documents anew."""
    order = sorted(range(len(bins)), key=fills(bins, sizes).__getitem__)
    out = set(order[: max(1, len(bins) // 20)]) | set(rng.choice(len(bins), max(1, len(bins) // 20)).tolist())
    items = [i for k in out for i in bins[k]]
    weight = {i: sizes[i] * rng.uniform(0.8, 1.2) for i in items}
    return best_fit(sorted(items, key=lambda i: -weight[i]), sizes, capacity, [b for k, b in enumerate(bins) if k not in out])


def seeds(sizes: list[int], capacity: int, count: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """Best-fit decreasing, then best-fit in disturbed orders."""
    n = len(sizes)
    floor = -(-sum(sizes) // capacity)
    found = [best_fit(sorted(range(n), key=lambda i: -sizes[i]), sizes, capacity)]
    while len(found) < count and len(found[0]) > floor:
        keys = np.array(sizes) * rng.uniform(0.7, 1.0, n)
        found.append(best_fit(np.argsort(-keys).tolist(), sizes, capacity))
    return found


def evolve(population: list[list[list[int]]], sizes: list[int], capacity: int, generations: int, rng: np.random.Generator):
    """The population after some generations, best first; it stops where the size bound is met."""
    floor = -(-sum(sizes) // capacity)

    def rated(groupings):
        return [(fitness(g, sizes, capacity), g) for g in groupings]

    ranked = sorted(rated(population), key=lambda r: r[0])
    for _ in range(generations):
        best = ranked[0][1]
        if len(best) <= floor:
            break
        a, b = sorted(rng.choice(len(ranked), 2, replace=len(ranked) < 2))
        first, second = ranked[a][1], ranked[b][1]
        children = [cross(second, first, sizes, capacity, rng), cross(first, second, sizes, capacity, rng), shake(best, sizes, capacity, rng)]
        ranked = sorted([*ranked, *rated(children)], key=lambda r: r[0])[: max(len(ranked), 2)]
    return [g for _, g in ranked]


# --- the job --------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, memo_entries: int | None = None) -> DataFrame:
    """Pieces of at most `capacity` tokens of each document, with their place and checksum.

    Only longer documents are cut; their first piece takes the remainder.  A null or
    empty text is one piece of the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, memo_entries)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            doc_ids = iter(batch.column(0).to_pylist())
            for ids, bounds in encode.encode_many((t.as_py() for t in batch.column(1)), end_id):
                for first, last, doc_id in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc_ids):
                    n = last - first
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[first + a : first + b]))):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, memo_entries: int | None = None) -> DataFrame:
    """Pack `docs` (doc_id, text) into as few sequences of `capacity` tokens as found.

    One row per piece: the columns of `token_pieces`, sequence_id and offset.  Rows
    that repeat a doc_id are documents of their own; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored.  `memo_entries` bounds the segments
    whose ids a worker remembers, and changes no result.
    """
    pieces = stage(token_pieces(docs, tokenizer, end_id, capacity, memo_entries).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long"))
    items = pieces.where(F.col("length") < capacity)
    packed = pack_items(items.select("uid", F.col("length").alias("size")), capacity)
    parts = items.join(packed, "uid")
    return whole.select(*parts.columns).unionByName(parts).drop("uid")


def pack_items(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Pack items (uid, size <= capacity) and return uid, sequence_id, offset.

    The number of shards follows the number of items.  Each level releases the
    RELEASED_BINS emptiest sequences of every shard to the next; the last level is
    one shard.  Levels: the logarithm of the number of items.
    """
    settled, level = None, 0
    while True:
        n = items.count()
        shards = max(1, -(-n // shard_items))
        level_out = stage(_pack_level(items, capacity, shards, level), f"packed-{level}")
        done = level_out if shards == 1 else level_out.where(~F.col("released"))
        done = done.select("uid", "sequence_id", "offset")
        settled = done if settled is None else settled.unionByName(done)
        if shards == 1:
            return settled
        items = level_out.where("released").select("uid", "size")
        level += 1


def _pack_level(items: DataFrame, capacity: int, shards: int, level: int) -> DataFrame:
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))
    state = dealt.groupBy("shard").applyInPandas(_deal, _STATE)
    for epoch in range(EPOCHS):
        state = state.groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch, level), _STATE)
    rows = "uid long, size long, sequence_id long, offset long, released boolean"
    return state.groupBy("shard").applyInPandas(_winner(capacity, level), rows)


def _deal(group: pd.DataFrame) -> pd.DataFrame:
    """One state row per island, all with the shard's items and no grouping yet."""
    group = group.sort_values("uid")
    uids, sizes = group["uid"].to_numpy("<i8").tobytes(), group["size"].to_numpy("<i4").tobytes()
    return pd.DataFrame({
        "shard": int(group["shard"].iloc[0]), "island": range(ISLANDS), "migrant": False,
        "uids": [uids] * ISLANDS, "sizes": [sizes] * ISLANDS, "groupings": [b""] * ISLANDS,
    })


def _labels(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    return [b.tolist() for b in np.split(order, cuts)]


def _population(data: bytes, n: int) -> list[list[list[int]]]:
    return [_bins(row) for row in np.frombuffer(data, "<i4").reshape(-1, n)] if data else []


def _epoch(capacity: int, epoch: int, level: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group[~group["migrant"]].iloc[0]
        sizes = np.frombuffer(own["sizes"], "<i4").tolist()
        shard, island, n = int(own["shard"]), int(own["island"]), len(sizes)
        rng = np.random.default_rng([shard, island, epoch, level])
        population = _population(own["groupings"], n) or seeds(sizes, capacity, POPULATION, rng)
        for data in group.loc[group["migrant"], "groupings"]:
            population += _population(data, n)
        ranked = evolve(population, sizes, capacity, GENERATIONS, rng)[:POPULATION]
        if len(ranked[0]) <= -(-sum(sizes) // capacity):
            ranked = ranked[:1]  # no grouping can be smaller
        blobs = [_labels(b, n) for b in ranked]
        rows = [(shard, island, False, own["uids"], own["sizes"], b"".join(blobs)), (shard, (island + 1) % ISLANDS, True, b"", b"", blobs[0])]
        return pd.DataFrame(rows, columns=["shard", "island", "migrant", "uids", "sizes", "groupings"])

    return run


def _winner(capacity: int, level: int):
    def pick(group: pd.DataFrame) -> pd.DataFrame:
        own = group[~group["migrant"]].sort_values("island")
        sizes = np.frombuffer(own["sizes"].iloc[0], "<i4")
        uids = np.frombuffer(own["uids"].iloc[0], "<i8")
        listed = sizes.tolist()
        found = [g for data in own["groupings"] for g in _population(data, len(listed))]
        bins = sorted(min(found, key=lambda g: fitness(g, listed, capacity)), key=lambda b: (sum(listed[i] for i in b), b))
        base = (level << 58) + (int(group["shard"].iloc[0]) << 20)
        rows = []
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                rows.append((uids[i], listed[i], base + k, at, k < RELEASED_BINS))
                at += listed[i]
        return pd.DataFrame(rows, columns=["uid", "size", "sequence_id", "offset", "released"])

    return pick
