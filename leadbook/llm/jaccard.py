"""N-gram Jaccard join by parity sketches.

A text's set of word n-grams XORs one bit per element into a sketch, so two
sketches differ in at most as many bits as the sets have elements not in common.
Sets that can reach the similarity differ in at most d elements, d following from
their sizes; a sketch is therefore cut into d + m blocks, of which such sets share
at least m.  Sets of one size band meet by equal blocks, and the texts of those
that meet are compared exactly.  Since similar sets share several blocks, a set leaves
out the most frequent ones: all but one of those that it must share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadbook.llm.components import components
from leadbook.llm.key_blocks import by_part, pack, pack_keys, unpack, unpack_keys
from leadbook.llm.worker_cache import release
from leadbook.runtime import discard, stage

# Bits of a sketch block: wide enough that few elements of a block share a bit.
BLOCK_BITS = 4096
# Bits of the sketch that a candidate pair is held against before its texts are: as many as the set has elements,
# a power of two between these.  Fewer would be full for a long text, and no bound.
SKETCH_BITS, MOST_SKETCH_BITS = 1024, 16_384
# Sizes of a band lie within this ratio.
BAND_RATIO = 1.4
# Candidates that a set proposes in a group grow by this factor from round to round, until none is held back.
ROUND_GROWTH = 8
# Sets of a group that one task compares; larger groups are cut into blocks and compared by pairs of blocks.
GROUP_SETS = 4_096
# Bytes of sketches of the groups that are dealt to one task, and that are compared at once.
TASK_BYTES = 6_400_000
STEP_BYTES = 8_000_000
# Characters of text for each part of the key space, and keys that a chunk of documents asks about at once.
PART_CHARS = 16_000_000
CHUNK_KEYS = 500_000

# A key's band stands above these bits.
_BAND_AT = 56
_BELOW_BAND = np.uint64((1 << _BAND_AT) - 1)

_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text.

    Words are runs of bytes other than space and U+0009..U+000D; A-Z is lower-cased.  A
    text with fewer words is one n-gram of them all; without words the set is empty.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = mix(rolled + hashed[k : k + n] * _C1 + np.uint64(k + 1))
    return np.unique(rolled)


@dataclass(frozen=True)
class Bands:
    """Size bands and their numbers of blocks for a similarity of at least num / den."""

    num: int
    den: int

    def difference(self, a: int, b: int) -> int:
        """The most elements not in common that sets of these sizes may have."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def partner(self, a: int) -> int:
        """The largest size that a set of size a can be similar to."""
        return a * self.den // self.num

    @lru_cache(maxsize=None)  # noqa: B019
    def lowest(self) -> int:
        """The smallest size whose set can be similar to a different one."""
        a = 1
        while not self.difference(a, self.partner(a)):
            a += 1
        return a

    @lru_cache(maxsize=None)  # noqa: B019
    def start(self, band: int) -> int:
        if not band:
            return self.lowest()
        last = self.start(band - 1)
        return max(last + 1, int(last * BAND_RATIO))

    @lru_cache(maxsize=None)  # noqa: B019
    def blocks(self, band: int) -> tuple[int, int]:
        """Number of blocks, and m: how many of them similar sets share at least."""
        low, high = self.start(band), self.start(band + 1) - 1
        d = self.difference(high, self.partner(high))
        m = 3 + d.bit_length() - 1
        empty = (d + m) * math.exp(-low / (d + m))
        m += math.ceil(empty + 6 * math.sqrt(empty)) if empty > 1 else 0
        return d + m, m

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size can meet a similar one, as the smaller or the larger."""
        if size < self.lowest():
            return []
        band = 0
        while self.start(band + 1) <= size:
            band += 1
        found = [band]
        while band and size <= self.partner(self.start(band) - 1):
            band -= 1
            found.append(band)
        return found


def sketch_blocks(hashes: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Keys of the non-empty sketch blocks of a set, and (band, how many of its keys similar sets share at least).

    The band stands in the first byte of a key.  Similar sets share at least m blocks in the band of the smaller;
    those without a set bit have no key, so as many keys as m is larger than the set's empty blocks.  Similar sets
    that share no block with a set bit share at least m empty ones; a set with that many, which m makes very rare,
    has one more key in common with its like.
    """
    keys, least = [], []
    for band in bands.of(len(hashes)):
        count, m = bands.blocks(band)
        block = ((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        bit = np.sort(block * np.uint64(BLOCK_BITS) + (hashes & np.uint64(BLOCK_BITS - 1)))
        edge = np.flatnonzero(np.concatenate([[True], bit[1:] != bit[:-1], [True]]))
        bit = bit[edge[:-1]][np.diff(edge) % 2 == 1]  # an even number of elements leaves a bit unset
        salt = mix(np.array([band + 1], np.uint64))
        value = mix(bit * _C1 + salt)
        block = bit // np.uint64(BLOCK_BITS)
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
        own = [mix(np.add.reduceat(value, cut) ^ (block[cut] * _C2 + salt))] if len(cut) else []
        if count - len(cut) >= m:
            own.append(mix(salt))
        keys += [(k & _BELOW_BAND) | np.uint64(band << _BAND_AT) for k in own]
        least.append((band, max(1, m - count + len(cut))))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), least


def block_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys alone."""
    return sketch_blocks(hashes, bands)[0]


def sketch_of(hashes: np.ndarray) -> bytes:
    """The set's parity sketch."""
    bits = min(MOST_SKETCH_BITS, max(SKETCH_BITS, 1 << (len(hashes) - 1).bit_length()))
    places = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def narrowed(sketch: bytes, size: int) -> np.ndarray:
    """A sketch folded to `size` bytes: the one the set has in fewer bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(len(sketch) // size, -1), axis=0)


_SKETCHED = (
    "uid long, doc_id long, n_shingles long, node long, sketch binary, least map<int, int>, chunk long, place int, part long, asked binary, places binary"
)


def sketched(docs: DataFrame, words: int, bands: Bands, parts: int) -> DataFrame:
    """Rows of documents, and of the block keys of their chunks.

    A document's row has the size, identity and sketch of its set, by band the least number of keys that it
    shares with a similar one, and its place in its chunk.  The
    identity is a 64-bit hash of the set (null for the empty set): n sets collide with a chance of
    n^2 / 2^65.  A row with a `part` has the sorted keys of a chunk in that part of the key space, each
    with the place of a document of every set that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        chunk, held, size, place = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            sizes, nodes, sketches, keys, least = [], [], [], [], []
            for text in batch.column(2):
                hashes = shingles(text.as_py(), words)
                sizes.append(len(hashes))
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63 if len(hashes) else None)
                sketches.append(sketch_of(hashes) if len(hashes) else None)
                for column, value in zip((keys, least), sketch_blocks(hashes, bands)):
                    column.append(value)
            lengths = [len(k) for k in keys]
            places = np.arange(place, place + len(sizes), dtype=np.uint32)
            named = np.array([n or 0 for n in nodes], np.int64)
            held.append((np.concatenate([*keys, np.zeros(0, np.uint64)]), np.repeat(named, lengths), np.repeat(places, lengths)))
            yield _batch({
                "uid": batch.column(0), "doc_id": batch.column(1), "n_shingles": sizes, "node": nodes, "sketch": sketches, "least": least,
                "chunk": [chunk] * len(sizes), "place": places.tolist(),
            })
            size, place = size + sum(lengths), place + len(sizes)
            if size >= CHUNK_KEYS:
                yield _asks(chunk, held, parts)
                chunk, held, size, place = chunk + 1, [], 0, 0
        if size:
            yield _asks(chunk, held, parts)

    return docs.select("uid", "doc_id", "text").mapInArrow(run, _SKETCHED)


_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("uid", "doc_id", "n_shingles", "node")] + [("sketch", pa.binary()), ("least", pa.map_(pa.int32(), pa.int32())), ("chunk", pa.int64())]
    + [("place", pa.int32()), ("part", pa.int64()), ("asked", pa.binary()), ("places", pa.binary())]
)


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns.get(f.name), pa.Array) else pa.array(c if c is not None else [None] * n, f.type) for f in _ARROW], schema=_ARROW
    )


def _asks(chunk: int, held: list[tuple[np.ndarray, ...]], parts: int) -> pa.RecordBatch:
    """The rows of a chunk's keys, one a part; a set of several documents counts once."""
    keys, nodes, places = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((nodes, keys))
    keys, nodes, places = keys[order], nodes[order], places[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
    keys, places = keys[first], places[first]
    rows = by_part(keys, parts)
    return _batch({
        "chunk": [chunk] * len(rows), "part": [p for p, _ in rows],
        "asked": [pack_keys(keys[ix]) for _, ix in rows], "places": [pack(places[ix].astype("<u4")) for _, ix in rows],
    })


def _shared_keys(group: pd.DataFrame) -> pd.DataFrame:
    """(key, chunk, place, uses) for the keys of a part that occur more than once."""
    keys = [unpack_keys(k) for k in group["asked"]]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    uses = np.diff([*first, len(flat)])
    kept = order[np.repeat(uses > 1, uses)]
    chunks = np.repeat(group["chunk"].to_numpy(np.int64), [len(k) for k in keys])
    places = np.concatenate([unpack(p, "<u4") for p in group["places"]])
    often = np.repeat(uses, uses)[np.repeat(uses > 1, uses)]
    return pd.DataFrame({"key": flat[kept].view(np.int64), "chunk": chunks[kept], "place": places[kept].astype(np.int32), "uses": often})


def _rarest(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, node): the shared keys of a set without the most frequent ones, in each band all but one of those it must share.

    Two sets that share as many keys as each must still share one: in the one order of all keys, the rarest of those
    in common has all the others behind it.  A set with fewer shared keys than it must share is similar to none.
    """
    held = shared.join(rows.select("chunk", "place", "node", "least"), ["chunk", "place"])
    band = F.shiftrightunsigned("key", _BAND_AT).cast("int")
    frequent = Window.partitionBy("chunk", "place", "band").orderBy(F.desc("uses"), F.desc("key"))
    ranked = held.withColumn("band", band).withColumn("rank", F.row_number().over(frequent))
    return ranked.where(F.col("rank") >= F.col("least")[F.col("band")]).select("key", "node").distinct()


def _candidates(bands: Bands, limit: int):
    """Pairs of a group whose sketches differ in no more bits than similar sets may.

    Only pairs of different components count.  Each set proposes its `limit` smallest; `more`
    tells that it holds others back.  A set that is in any such pair, proposed or not, is also
    paired with itself.
    """

    def near(bits: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        most = (n[low] + n[high]) * (bands.den - bands.num) // (bands.den + bands.num)
        step = max(1, STEP_BYTES // bits[:1].nbytes)
        apart = [np.bitwise_count(bits[low[k : k + step]] ^ bits[high[k : k + step]]).sum(1) for k in range(0, len(low), step)]
        return np.concatenate([*apart, np.zeros(0, int)]) <= most

    def meet(rows: pd.DataFrame, size: int) -> pd.DataFrame:
        """The pairs of groups whose sketches are compared in `size` bytes."""
        group, node, root, n, side = (rows[c].to_numpy() for c in ("group", "node", "root", "n", "side"))
        bits = np.stack([narrowed(sketch, size) for sketch in rows["sketch"]])
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        last = np.repeat(edge[1:], np.diff(edge))
        proposed, held, met = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        room = last - np.arange(len(rows))
        for shift in range(int(room.max()) - 1, 0, -1):
            low = np.flatnonzero(room > shift)
            high = low + shift
            small, large = np.minimum(n[low], n[high]), np.maximum(n[low], n[high])
            fits = (root[low] != root[high]) & (node[low] != node[high]) & (small * bands.den >= large * bands.num)
            fits &= (side[low] != side[high]) | (side[low] == 0)  # side 0: the block meets itself
            low, high = low[fits], high[fits]
            alike = near(bits, n, low, high)
            low, high = low[alike], high[alike]
            met[low] = met[high] = True
            full = proposed[high] >= limit
            held[high[full]] = True
            low, high = low[~full], high[~full]
            proposed[high] += 1
            found.append((node[high], node[low]))
        found.append((node[met], node[met]))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b, "more": np.isin(a, node[held])})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["group", "node"])
        sizes = rows["sketch"].map(len).groupby(rows["group"]).transform("min")  # sets of a group differ little in size
        return pd.concat([meet(some, int(size)) for size, some in rows.groupby(sizes)]).drop_duplicates()

    return run


def _dealt(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """From rows (key, node, root) those of keys with several roots, with `group`, `side`, and n and sketch of `sets`.

    A group of more than GROUP_SETS sets is cut into blocks by hash; each pair of its blocks
    is a group of its own, in which only sets of different blocks meet (side 1 and 2).
    """
    sizes = blocks.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    open_ = blocks.join(sizes.select("key", "size"), "key")
    cuts = F.ceil(F.col("size") / GROUP_SETS).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda j: F.struct(
            F.xxhash64("key", F.least(F.col("block"), j), F.greatest(F.col("block"), j)).alias("group"),
            F.when(F.col("block") == j, 0).when(F.col("block") < j, 1).otherwise(2).alias("side"),
        ),
    )
    cut = open_.withColumn("cuts", cuts).withColumn("block", block)
    return cut.withColumn("pair", F.explode(pairs)).select("pair.*", "node", "root").join(sets.select("node", "n", "sketch"), "node")


def similar(pairs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose texts reach the similarity, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, known = None, None
        for batch in batches:
            linked = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != pivot:
                    pivot, known = b, shingles(text_b.as_py(), words)
                own = shingles(text_a.as_py(), words)
                common = len(np.intersect1d(own, known, assume_unique=True))
                linked.append(bands.den * common >= bands.num * (len(own) + len(known) - common))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").sortWithinPartitions("b").mapInArrow(run, "a long, b long")


def similarity_groups(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Group the rows of `docs` (uid, doc_id, text) by links between similar texts.

    Returns uid, doc_id, n_shingles, lead_id and lead_uid: the smallest doc_id reachable by
    links, and the row that has it.  Two rows link when their n-gram sets have a Jaccard
    similarity of at least num / den; equal sets are one node.  An empty set (null text, or
    one without words) links with nothing and leads itself.  uid must be unique; among equal
    doc_ids the smaller uid leads, null doc_ids come last.  An empty table gives no rows.

    Only pairs within one component are ever left uncompared: in each round the sets of a
    block's group propose candidates outside their component, smallest first, links are
    verified and components joined, until no set holds a candidate back.
    """
    bands = Bands(num, den)
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parts = max(8, -(-chars // PART_CHARS))
    table = stage(sketched(docs, words, bands, parts), "sketched")
    rows = table.where(F.col("part").isNull())
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")
    nodes = rows.where(F.col("node").isNotNull())
    classes = nodes.groupBy("node").agg(F.min(order).alias("lead"), F.max("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
    classes = stage(classes, "classes")
    asks = table.where(F.col("part").isNotNull()).select("part", "chunk", "asked", "places")
    shared = asks.groupBy("part").applyInPandas(_shared_keys, "key long, chunk long, place int, uses long")
    blocks = stage(_rarest(shared, rows), "blocks")
    links = stage(_links(docs, blocks, classes, words, bands), "all-links")
    discard(blocks)
    roots = components(links)
    at = F.coalesce("root", "node").alias("root")
    rooted = classes.join(roots, "node", "left").select("node", "lead", at)
    leads = rooted.groupBy("root").agg(F.min("lead").alias("first"))
    labels = stage(rooted.select("node", "root").join(leads, "root").select("node", "first"), "labels")
    discard(links, classes)
    joined = rows.select("uid", "doc_id", "n_shingles", "node").join(labels, "node", "left")
    empty = F.col("node").isNull()
    return joined.select(
        "uid",
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("lead_id"),
        F.when(empty, F.col("uid")).otherwise(F.col("first.uid")).alias("lead_uid"),
    )


def _links(docs: DataFrame, blocks: DataFrame, classes: DataFrame, words: int, bands: Bands) -> DataFrame:
    """Verified links that connect all sets that are connected by any links.

    In a round a set has its texts compared with at most `limit` others, so that the first round, after which
    groups of near copies are mostly one component, compares no more pairs than there are sets.  No pair is compared twice.
    The first round sees every pair of a group, so later ones deal only the sets that it found in a candidate pair.
    """
    schema = "a long, b long, more boolean"
    texts = met = links = None
    compared: list[DataFrame] = []
    limit = 1
    roots = blocks.withColumn("root", F.col("node"))
    while True:
        dealt = stage(_dealt(roots, classes), "groups")
        held = dealt.agg(F.sum(F.octet_length("sketch"))).first()[0] or 0
        tasks = max(1, -(-held // TASK_BYTES))
        tasked = dealt.groupBy(F.pmod("group", F.lit(tasks)).alias("task"))
        pairs = stage(tasked.applyInPandas(_candidates(bands, limit), schema), "candidates")
        discard(dealt)
        if limit == 1:  # texts of the sets that are in any candidate pair, of this or a later round
            nodes = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
            needed = nodes.join(classes.select("node", F.col("lead.uid").alias("uid")), "node")
            texts = stage(needed.join(docs.select("uid", "text"), "uid").select("node", "text"), "group-texts")
            met = stage(blocks.join(nodes, "node", "left_semi").select(*blocks.columns), "met-blocks")
        fresh = pairs.where("a <> b").select("a", "b").distinct()
        if compared:
            tried = reduce(DataFrame.unionByName, [c.where(F.col("place") <= F.col("most")) for c in compared])
            fresh = fresh.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        ranked = stage(fresh.withColumns({"place": place, "most": F.lit(limit)}), "fresh")
        chosen = ranked.where(F.col("place") <= limit).select("a", "b")
        compared.append(ranked)
        left = chosen.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        found = stage(similar(both.select("a", "b", "text_a", "text_b"), words, bands), "similar")
        links = found if links is None else links.unionByName(found)
        done = pairs.where("more").isEmpty() and ranked.where(F.col("place") > limit).isEmpty()
        discard(pairs)
        if done:
            discard(texts, met, *compared)
            return links
        known = components(links)
        roots = met.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
        limit *= ROUND_GROWTH
