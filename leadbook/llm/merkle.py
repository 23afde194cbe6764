"""Merkle manifest of a table: a content-addressed graph of digests, and proofs by descent.

Every row is a leaf.  The leaves of a language, in order, are hashed in runs of
`fan_out` until one digest is left, and so are the digests of the languages.  What is
stored is records, digest -> digests of its children, bundled by segments of the tree: a
bundle has the records of the nodes at most SEGMENT_LEAVES apart from their top's
digest, under which it is looked up.

A proof is found from the root down: a request carries the digest it has come to,
looks up the bundle of that digest, and follows the digits of its rank through the
records, collecting the children it does not follow.  Requests that share the upper part
of their way are one request until they part, so each segment is one join with a row per
bundle, and the work grows with the rows.  At the leaf the path is reversed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadbook.runtime import lookup_join, stage
from leadbook.spread import ranked

FAN_OUT = 2
# Nodes at the lower end of a segment, at most.
SEGMENT_LEAVES = 256
# The tree that a node belongs to.
TREE = ["known", "name"]

_STEPS = "path array<struct<before:string,after:string>>"
_PATHS = "paths array<array<struct<before:string,after:string>>>"
_PLACE = "known boolean, name string, block long"
_BLOCK = f"{_PLACE}, n long, top string, records array<struct<digest:binary,children:binary>>"
_REQUEST = f"{_PLACE}, digest string, root string, subroot string, {_STEPS}"
_STEP_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_REQUEST_ARROW = pa.schema([
    ("known", pa.bool_()), ("name", pa.string()), ("block", pa.int64()), ("digest", pa.string()),
    ("root", pa.string()), ("subroot", pa.string()), ("path", _STEP_ARROW),
])
_BLOCK_ARROW = pa.schema([
    ("known", pa.bool_()), ("name", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("top", pa.string()),
    ("records", pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.binary())]))),
])
_DIGEST_BYTES = 32


def joined_digest(*values: Column) -> Column:
    """sha256 in hex of values as text, each behind its length in bytes, a null as a dash: no two rows read alike."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def height_of(n: int, fan_out: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_out), levels + 1
    return levels


def segment_levels(fan_out: int) -> int:
    """Levels of a segment: the most that keep it within SEGMENT_LEAVES, but one at least."""
    levels = 1
    while fan_out ** (levels + 1) <= SEGMENT_LEAVES:
        levels += 1
    return levels


def hash_up(digests: list[str], levels: int, fan_out: int) -> tuple[str, list[tuple[bytes, bytes]]]:
    """The top digest over a run of nodes, and the records (digest, children) below it."""
    records = []
    for _ in range(levels):
        above = []
        for k in range(0, len(digests), fan_out):
            children = "".join(digests[k : k + fan_out])
            digest = sha256(children.encode()).hexdigest()
            records.append((bytes.fromhex(digest), bytes.fromhex(children)))
            above.append(digest)
        digests = above
    return digests[0], records


def follow(top: str, records: dict[bytes, bytes], rank: int, levels: int, fan_out: int) -> tuple[str, list[dict]]:
    """The digest that a rank's digits lead to from `top`, and the children beside the way, from the top down."""
    steps = []
    for level in range(levels - 1, -1, -1):
        children = records[bytes.fromhex(top)].hex()
        at = rank // fan_out**level % fan_out * 2 * _DIGEST_BYTES
        steps.append({"before": children[:at], "after": children[at + 2 * _DIGEST_BYTES :]})
        top = children[at : at + 2 * _DIGEST_BYTES]
    return top, steps


@dataclass(frozen=True)
class Forest:
    """Trees over ranked nodes: bundles of each segment from the leaves up, and one row per tree."""

    segments: list[DataFrame]  # known, name, block, n, top, records
    roots: DataFrame  # known, name, n, digest
    fan_out: int


def _segment(levels: int, fan_out: int):
    """Bundles over the nodes of blocks: (place, n, members) -> _BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = fan_out**levels
        for batch in batches:
            for row in batch.to_pylist():
                height = levels if row["n"] > width else height_of(row["n"], fan_out)
                top, records = hash_up(row["digests"], height, fan_out)
                kept = {"known": row["known"], "name": row["name"], "block": row["block"], "n": row["n"], "top": top}
                kept["records"] = [{"digest": d, "children": c} for d, c in records]
                yield pa.RecordBatch.from_pylist([kept], schema=_BLOCK_ARROW)

    return run


def build_forest(nodes: DataFrame, fan_out: int = FAN_OUT) -> Forest:
    """Trees over staged nodes (known, name, rank, digest): one per (known, name), with ranks from 0 without gaps."""
    levels = segment_levels(fan_out)
    width = fan_out**levels
    whole = sizes = stage(nodes.groupBy(*TREE).agg(F.count("*").alias("n")), "tree-sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    segments, roots = [], []
    while True:
        digests = F.array_sort(F.collect_list(F.struct("rank", "digest")))["digest"]
        blocks = nodes.groupBy(*TREE, _block_of("rank", width)).agg(digests.alias("digests"))
        counted = lookup_join(blocks, sizes, TREE, "block").select(*TREE, "block", "n", "digests")
        segments.append(stage(counted.mapInArrow(_segment(levels, fan_out), _BLOCK), "segment"))
        roots.append(segments[-1].where(F.col("n") <= width).select(*TREE, F.col("top").alias("digest")))
        if largest <= width:
            tops = reduce(DataFrame.unionByName, roots)
            return Forest(segments, stage(tops.join(whole, TREE), "roots"), fan_out)
        nodes = segments[-1].where(F.col("n") > width).select(*TREE, F.col("block").alias("rank"), F.col("top").alias("digest"))
        sizes = stage(sizes.where(F.col("n") > width).withColumn("n", _nodes_above("n", width)), "tree-sizes")
        largest = -(-largest // width)


def _block_of(rank: str, width: int) -> Column:
    return F.floor(F.col(rank) / width).cast("long").alias("block")


def _nodes_above(n: str, width: int) -> Column:
    return F.ceil(F.col(n) / width).cast("long")


def _descent(levels: int, fan_out: int):
    """Requests one segment further down: a request with its bundle becomes one request per node at the lower end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] * fan_out**levels
                ways = _ways(row, levels, fan_out)
                out = [{**row, "block": first + k, "digest": digest, "path": row["path"] + steps} for k, (digest, steps) in enumerate(ways)]
                yield pa.RecordBatch.from_pylist(out, schema=_REQUEST_ARROW)

    return run


def _ways(row: dict, levels: int, fan_out: int) -> list[tuple[str, list[dict]]]:
    """(digest, steps) for every node at the lower end of a request's segment."""
    width = fan_out**levels
    height = levels if row["n"] > width else height_of(row["n"], fan_out)
    records = {r["digest"]: r["children"] for r in row["records"] or ()}
    return [follow(row["digest"], records, rank, height, fan_out) for rank in range(min(width, row["n"] - row["block"] * width))]


def _arrival(levels: int, fan_out: int):
    """The lowest segment: every member of a block gets its whole path, turned to run from the leaf up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.select([*TREE, "block", "n", "digest", "path", "records"]).to_pylist()
            for k, row in enumerate(asked):
                paths = [(row["path"] + steps)[::-1] for _, steps in _ways(row, levels, fan_out)]
                kept = [batch.column(c).slice(k, 1) for c in ("root", "subroot", "members")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([paths], pa.list_(_STEP_ARROW))], ["root", "subroot", "members", "paths"])

    return run


def descend(forest: Forest, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of `nodes`, the forest's ranked leaves, with root, subroot and the path from the leaf up.

    `starts` are requests (known, name, digest, root, subroot, path) at the tops of
    all trees.  Trees of different heights join in at their own segment.
    """
    levels = segment_levels(forest.fan_out)
    width, requests = forest.fan_out**levels, None
    tall = forest.roots.select(*TREE, "n")
    for k in range(len(forest.segments) - 1, -1, -1):
        here = _nodes_above("n", width**k)
        # Trees whose top stands in this segment join those that come from the one above.
        at_top = (here <= width) & ((here > 1) if k else F.lit(True))
        coming = starts.join(tall.where(at_top), TREE).withColumns({"block": F.lit(0).cast("long"), "n": here})
        if requests is not None:
            coming = coming.unionByName(lookup_join(requests, tall, TREE, "block").withColumn("n", here))
        bundles = forest.segments[k].groupBy(F.col("top").alias("digest")).agg(F.first("records").alias("records"))
        met = coming.join(bundles, "digest")
        if k:
            requests = stage(met.mapInArrow(_descent(levels, forest.fan_out), _REQUEST), "requests")
    payload = F.struct("rank", *[c for c in nodes.columns if c not in (*TREE, "rank")])
    members = nodes.groupBy(*TREE, _block_of("rank", width)).agg(F.array_sort(F.collect_list(payload)).alias("members"))
    whole = met.join(members, [*TREE, "block"])
    kind = T.StructType([*whole.select("root", "subroot", "members").schema, *T.StructType.fromDDL(_PATHS)])
    found = whole.mapInArrow(_arrival(levels, forest.fan_out), kind)
    each = found.select("root", "subroot", F.explode(F.arrays_zip("members", "paths")).alias("e"))
    return each.select("e.members.*", "root", "subroot", F.col("e.paths").alias("path"))


@dataclass(frozen=True)
class Manifest:
    """The trees over the rows of each group, the tree over the groups, and the ranked leaves of both."""

    leaves: DataFrame
    trees: Forest
    groups: DataFrame
    top: Forest


def build_manifest(leaves: DataFrame, group: str, order: list[str], fan_out: int = FAN_OUT) -> Manifest:
    """One tree per value of `group` (null: one of its own, first) over rows with a `digest`, ordered by `order`, then digest."""
    named = leaves.withColumns({"known": F.col(group).isNotNull(), "name": F.coalesce(F.col(group), F.lit(""))}).drop(group)
    placed = ranked(named, TREE, [*order, "digest"])
    trees = build_forest(placed.select(*TREE, "rank", "digest"), fan_out)
    tops = trees.roots.select(F.lit(0).alias("whole"), F.col("known").alias("of_known"), F.col("name").alias("of_name"), "digest")
    numbered = ranked(tops, ["whole"], ["of_known", "of_name"]).drop("whole")
    groups = numbered.withColumns({"known": F.lit(True), "name": F.lit("")})
    return Manifest(placed, trees, groups, build_forest(groups.select(*TREE, "rank", "digest"), fan_out))


def manifest_records(manifest: Manifest) -> DataFrame:
    """The stored graph: (digest, children) of every inner node, once however often it stands in the trees."""
    bundles = reduce(DataFrame.unionByName, [s.select("records") for s in (*manifest.trees.segments, *manifest.top.segments)])
    records = bundles.select(F.explode("records").alias("r")).select("r.*").distinct()
    each = F.sequence(F.lit(1), F.octet_length("children"), F.lit(_DIGEST_BYTES))
    children = F.transform(each, lambda k: F.lower(F.hex(F.substring(F.col("children"), k, F.lit(_DIGEST_BYTES)))))
    return records.select(F.lower(F.hex("digest")).alias("digest"), children.alias("children"))


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf row with subroot, root, and its path from the leaf up: what stands before and after it at each level."""
    steps = "array<struct<before:string,after:string>>"
    one = {"root": F.col("digest"), "subroot": F.lit(None).cast("string"), "path": F.array().cast(steps)}
    reached = descend(manifest.top, manifest.top.roots.drop("n").withColumns(one), manifest.groups)
    # A path runs from the leaf up; a request still goes down.
    down = F.reverse("path").alias("path")
    starts = reached.select(F.col("of_known").alias("known"), F.col("of_name").alias("name"), "digest", "root", F.col("digest").alias("subroot"), down)
    return descend(manifest.trees, stage(starts, "starts"), manifest.leaves)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and a path from the leaf up lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def document_proofs(docs: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Per row of documents: leaf, subroot, root, proof_sha256, and what a changed row folds to.

    A leaf is the digest of doc_id, source, lang, n_chars and text.  Rows without lang
    are a language of their own, before all others.  Rows that repeat a doc_id
    are leaves of their own, ordered by digest; a null doc_id comes first.  Where 7 divides crc32(doc_id
    as text), the presented row has one more in n_chars; a null stays.  An empty table
    has no rows and no root.  Other columns are ignored.
    """
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaf = joined_digest(*fields, F.col("n_chars"), F.col("text"))
    tampered = joined_digest(*fields, F.col("n_chars") + 1, F.col("text"))
    hashed = docs.select("doc_id", "lang", leaf.alias("digest"), F.when(changed, tampered).alias("presented"))
    rows = proofs(build_manifest(stage(hashed, "leaves"), "lang", ["doc_id"], fan_out))
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    root = folded(F.coalesce("presented", "digest"), F.col("path"))
    out = rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), root.alias("folded_root"), "path"
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
