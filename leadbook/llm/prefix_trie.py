"""Prefix trie of conversations by van Emde Boas recursion.

All sequences of turns are cut at half depth, the prefixes up to the cut are named, and
the upper trie and the lower forests are cut in the same way, all at once, until every
depth has names.  A name is a digest of the name at the cut before and of the turns
between; digests of runs of 2, 4, 8, ... turns are made first, so the rounds grow with
the logarithm of the longest conversation and each reads half of what the one
before it read, or twice as much.

Totals then go the other way.  Every node begins with its own; a round doubles the
depth that a total covers by grafting the lower tries' roots onto all their ancestors in
the upper trie.  No conversation and no node's members come together in one task:
members are counted before they are shuffled, and everything else is keyed by
conversation and depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook.runtime import discard, stage
from leadbook.spread import ranked, spread_join

# Conversations whose number leaves this remainder's base share its first turns.
BASE_EVERY = 20
MOST_BORROWED = 4
WORD = r"[^\x20\x09-\x0D]+"
# Ids that one row holds when the members that end at a node are listed.
IDS_PER_CHUNK = 50_000

_CHUNKS = "name binary, first long, ids string"
_CHUNKS_ARROW = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = "name binary, ends_sha256 string"
_ENDS_ARROW = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])


def _digest(*parts: Column) -> Column:
    """32 bytes; the parts are of fixed length or the last."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """Staged (conv_id, turn, pos, content, words): turns in order, each with a digest of role and text and its words.

    Turns are ordered by number, a null first, and by content where the number
    repeats.  A null role or text is empty.  Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    length = F.concat(F.octet_length(role).cast("string"), F.lit(":"))
    content = _digest(F.concat(length, role, text).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    return ranked(stage(rows, "turns"), ["conv_id"], ["turn", "content"], "pos")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (conv_id, length) and (conv_id, pos, content, words) of the conversations as they are rebuilt.

    A conversation takes the first h turns of the one at the head of its twenty, h being the
    remainder of its id's crc32 by four, and keeps its own turns but the first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED
    own = stage(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % BASE_EVERY}), "own")
    heads = turns.where((F.col("conv_id") % BASE_EVERY == 0) & (F.col("pos") < MOST_BORROWED - 1))
    lent = heads.select(F.col("conv_id").alias("base"), "pos", "content", "words")
    taken = stage(own.join(lent, "base").where("pos < h").select("conv_id", "pos", "content", "words"), "taken")
    many = taken.groupBy("conv_id").agg(F.count("*").alias("taken"))
    sizes = stage(own.join(many, "conv_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0))), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = spread_join(turns.drop("turn"), sizes.select("conv_id", "n", "h", "taken"), ["conv_id"], F.col("n"), total).where("pos >= h")
    moved = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "content", "words")
    length = (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")
    return stage(sizes.select("conv_id", length), "lengths"), stage(moved.unionByName(taken), "rebuilt")


def _runs(turns: DataFrame, deepest: int) -> list[DataFrame]:
    """Digests of all full runs of 1, 2, 4, ... turns: (conv_id, run, content, words of the last turn)."""
    out = [turns.withColumnRenamed("pos", "run")]
    while 2 ** len(out) <= deepest:
        odd = F.col("run") % 2 == 1
        halves = out[-1].groupBy("conv_id", F.floor(F.col("run") / 2).cast("long").alias("half")).agg(
            F.max(F.when(~odd, F.col("content"))).alias("left"), F.max(F.when(odd, F.col("content"))).alias("right"), F.max(F.when(odd, F.col("words"))).alias("words")
        )
        both = halves.where("left IS NOT NULL AND right IS NOT NULL").select("conv_id", F.col("half").alias("run"), _digest(F.col("left"), F.col("right")).alias("content"), "words")
        out.append(stage(both, "runs"))
    return out


def named_prefixes(turns: DataFrame, deepest: int) -> DataFrame:
    """Staged (conv_id, depth, name, words of the last turn) of every prefix but the empty one.

    Two prefixes have one name exactly if they have the same turns.  A round cuts
    every open interval of depths in the middle, from the whole down to single turns.
    """
    runs, rounds = _runs(turns, deepest), []
    for level in range(len(runs) - 1, -1, -1):
        cut = 2**level
        # Runs that lie before a cut: their interval begins where a former round cut, or at the root.
        upper = runs[level].where("run % 2 = 0").select("conv_id", (F.col("run") * cut).alias("low"), "content", "words")
        at_root = upper.where("low = 0").withColumn("above", F.lit(b""))
        below = upper.where("low > 0")
        known = None
        for done in rounds:
            known = done if known is None else known.unionByName(done)
        if known is not None:
            names = known.select("conv_id", F.col("depth").alias("low"), F.col("name").alias("above"))
            at_root = at_root.unionByName(below.join(names, ["conv_id", "low"]))
        named = at_root.select("conv_id", (F.col("low") + cut).alias("depth"), _digest(F.col("above"), F.col("content")).alias("name"), "words")
        rounds.append(stage(named, "names"))
    out = rounds[0]
    for done in rounds[1:]:
        out = out.unionByName(done)
    return out


def _grafted(totals: DataFrame, path: DataFrame, deepest: int) -> DataFrame:
    """Totals over whole subtrees from (conv_id, depth, leaves, saved) of single nodes.

    `path` has the nodes on the way of each conversation, (conv_id, depth, node):
    a node is known by its smallest member and its depth.  After the round of 2^k turns, a
    total covers the depths up to the next multiple of 2^(k+1).
    """
    for level in range(deepest.bit_length()):
        span = 2**level
        interval = F.floor(F.col("depth") / span).cast("long")
        lower = totals.where((F.col("depth") % span == 0) & (interval % 2 == 1))
        # The ancestors of a lower trie's root in the upper trie lie on its smallest member's way.
        grafts = lower.select("conv_id", (interval - 1).alias("upper"), "leaves", "saved")
        ways = path.select("conv_id", "depth", "node", interval.alias("upper")).where("upper % 2 = 0")
        added = grafts.join(ways, ["conv_id", "upper"]).select(F.col("node").alias("conv_id"), "depth", "leaves", "saved")
        both = totals.unionByName(added).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        before, totals = totals, stage(both, "totals")
        discard(before)
    return totals


def _ended(members: DataFrame) -> DataFrame:
    """(name, ends_sha256) of nodes at which members (name, conv_id) end: the digest of their ids in order.

    The ids of a node may be many: each task joins those of its range to texts of
    at most IDS_PER_CHUNK ids, and a node's texts are digested one after another.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, []
        for batch in batches:
            out = []
            for own, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (own != name or len(ids) == IDS_PER_CHUNK):
                    out.append({"name": name, "first": ids[0], "ids": ",".join(map(str, ids))})
                    ids = []
                name = own
                ids.append(conv_id)
            yield pa.RecordBatch.from_pylist(out, schema=_CHUNKS_ARROW)
        if ids:
            yield pa.RecordBatch.from_pylist([{"name": name, "first": ids[0], "ids": ",".join(map(str, ids))}], schema=_CHUNKS_ARROW)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            out = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest is not None and own == name:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    out.append({"name": name, "ends_sha256": digest.hexdigest()})
                name, digest = own, sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema=_ENDS_ARROW)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"name": name, "ends_sha256": digest.hexdigest()}], schema=_ENDS_ARROW)

    listed = members.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(chunks, _CHUNKS)
    return listed.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, _ENDS)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    conv_id is the smallest member, depth the turns of the prefix, parent_conv_id the
    parent's smallest member (null at the root); n_convs, n_children, n_leaves and
    saved_tokens as counts, the latter two over the subtree; ends_sha256 digests the
    ids of the members that end here.  Rows that repeat are turns of their own.
    An empty table has no conversation and no node.  Other columns are ignored.
    """
    lengths, turns = rebuilt(turns_of(conversations))
    found = lengths.agg(F.max("length"), F.count("*"), F.min("conv_id"), F.coalesce(F.sum("length"), F.lit(0))).first()
    deepest, total = found[0] or 0, found[3]
    prefixes = named_prefixes(turns, deepest)
    by_name = prefixes.groupBy("name", "depth").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    named = stage(by_name, "nodes")
    # Every conversation's way through the nodes; the root stands on all of them.
    way = spread_join(prefixes.select("conv_id", "depth", "name"), named.select("name", "node", "n_convs"), ["name"], F.col("n_convs"), total)
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("name"), F.lit(found[2]).cast("long").alias("node"))
    path = stage(way.select("conv_id", "depth", "name", "node").unionByName(root), "path")
    top = lengths.groupBy().agg(F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(b"").alias("name"), F.lit(0).cast("long").alias("depth"), F.lit(found[2]).cast("long").alias("node"), "n_convs", F.lit(0).cast("long").alias("words")
    )
    nodes = named.unionByName(top).withColumnRenamed("node", "conv_id")
    # The parent of a node stands one turn up on its smallest member's way.
    up = path.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    parents = stage(nodes.join(up, ["conv_id", "depth"], "left"), "parents")
    children = parents.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = stage(parents.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    leaf = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    alone = counted.select("conv_id", "depth", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = _grafted(stage(alone, "totals"), path, deepest)
    ends = _ended(path.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("name", "conv_id"))
    out = counted.join(totals, ["conv_id", "depth"]).join(ends, "name", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
