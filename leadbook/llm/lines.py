"""Line dedup by pairwise alignment of documents that share lines.

A shared line pairs a later document with the first document that has it, and so do
two neighbouring lines with the first that has them in this order; a line or two that few
documents have pair all of these.  So the pairs grow with the lines and not with the square
of a line's documents, however common it is.  Equal lines of one text are told apart by their
ordinal (the second "x" of a text matches only a second "x"), and so are equal neighbours.
Per pair, the longest increasing run of common lines is the alignment, as in patience diff.
Runs of aligned lines leave the later document if they are long enough for the number of
documents that hold them.
"""

from __future__ import annotations

import math
import re
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.llm.worker_cache import release
from leadbook.runtime import stage

# Words that a run of aligned lines needs to be deleted: shorter ones may be chance.  A line
# counts its words once for every doubling of the documents that hold it.
BLOCK_WORDS = 10
# Characters that count as a word where there are fewer blanks, and letters of scripts that
# are written without blanks, of which two count as one.
WORD_CHARS = 6
# A line or two that at most so many documents have pair each of them with all earlier ones.
RARE_DOCS = 8
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_in(line: str) -> int:
    """Length of a line in words, whether or not its script sets blanks between them."""
    chars = len(line) if line.isascii() else len(line) + (WORD_CHARS // 2 - 1) * len(_UNSPACED.findall(line))
    return max(line.count(" ") + 1, chars // WORD_CHARS)


def weight_of(words: int, holders: int) -> float:
    """Words that a line counts for when so many documents hold it: those of two as they are."""
    return words * math.log2(max(2, holders))


def aligned(pairs: list[tuple[int, int]]) -> list[int]:
    """Patience diff: from (place here, place there) the places here of a longest common order, each place once."""
    tails, tail_at, before = [], [], {}
    for here, there in sorted(set(pairs), key=lambda p: (p[0], -p[1])):
        k = bisect_left(tails, there)
        tails[k : k + 1] = [there]
        tail_at[k : k + 1] = [(here, there)]
        before[here, there] = tail_at[k - 1] if k else None
    found, at = [], tail_at[-1] if tail_at else None
    while at is not None:
        found.append(at[0])
        at = before[at]
    return found[::-1]


def doomed_lines(matches: list[tuple[int, float, int, int]], block_words: int = BLOCK_WORDS) -> list[int]:
    """Places of the lines to delete from (place, words, partner, place there) of one document."""
    partners: dict[int, list[tuple[int, int]]] = {}
    words = {}
    for here, n, partner, there in matches:
        partners.setdefault(partner, []).append((here, there))
        words[here] = n
    common = sorted({here for pairs in partners.values() for here in aligned(pairs)})
    out, run = [], []
    for here in [*common, -1]:
        if run and here != run[-1] + 1:
            if sum(words[i] for i in run) >= block_words:
                out += run
            run = []
        run.append(here)
    return out


def without_lines(text: str, doomed: list[int]) -> str:
    """The text without the given lines, counted among those that are not blank."""
    gone, kept, at = set(doomed), [], -1
    for line in text.split("\n"):
        at += bool(line.strip())
        if not line.strip() or at not in gone:
            kept.append(line)
    return "\n".join(kept)


_LINES = "uid long, doc_id long, place int, words int, line long, ordinal int"
_KEYS = "key long, uid long, doc_id long, place int, weight double, next double"


def _lines(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows, places, words, keys, ordinals = [], [], [], [], []
            for row, text in enumerate(batch.column(2)):
                seen: Counter[str] = Counter()
                lines = [s for s in map(str.strip, (text.as_py() or "").split("\n")) if s]
                for place, line in enumerate(lines):
                    keys.append(xxhash.xxh3_64_intdigest(line) - 2**63)
                    ordinals.append(seen[line])
                    seen[line] += 1
                    rows.append(row)
                    places.append(place)
                    words.append(words_in(line))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(v, pa.int32()) for v in (places, words)), pa.array(keys, pa.int64()), pa.array(ordinals, pa.int32())],
                names=["uid", "doc_id", "place", "words", "line", "ordinal"],
            )

    return docs.select("uid", "doc_id", "text").mapInArrow(run, _LINES)


def line_keys(lines: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, float, float | None]]:
    """(key, place, weight, weight of the next line) from (place, words, line, ordinal, holders) of one document.

    A key is of a line and its ordinal, or of two neighbouring lines and theirs; only the latter has a next line.
    """
    out, seen, last = [], Counter(), None
    for place, words, line, ordinal, holders in sorted(lines):
        weight = weight_of(words, holders)
        out.append((xxhash.xxh3_64_intdigest(struct.pack("<qi", line, ordinal)) - 2**63, place, weight, None))
        if last and last[0] == place - 1:
            two = struct.pack("<qqi", last[1], line, seen[last[1], line])
            seen[last[1], line] += 1
            out.append((xxhash.xxh3_64_intdigest(two) - 2**63, place - 1, last[2], weight))
        last = (place, line, weight)
    return out


def _keys(lines: DataFrame) -> DataFrame:
    """Keys of the lines that several documents have."""
    shared = lines.where("ordinal = 0").groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
    row = F.struct("place", "words", "line", "ordinal", "n")
    own = lines.join(shared, "line").groupBy("uid", "doc_id").agg(F.collect_list(row).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = line_keys([tuple(m.values()) for m in batch.column(2)[k].as_py()])
                at = pa.array([k] * len(found), pa.int64())
                key, place, weight, after = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(place, pa.int32()), pa.array(weight, pa.float64()), pa.array(after, pa.float64())],
                    names=["key", "uid", "doc_id", "place", "weight", "next"],
                )

    return stage(own.mapInArrow(run, _KEYS), "line-keys")


def line_deletions(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """From `docs` (uid, doc_id, text) one row (uid, doomed) per document that loses lines."""
    keys = _keys(_lines(docs))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid", "place")
    # partial aggregation keeps a common key to one row a task
    first = keys.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    held = keys.join(first, "key")
    match = ["uid", "place", "weight", "next", "partner", "there"]
    matches = held.where("uid <> first.uid").select(*match[:4], F.col("first.uid").alias("partner"), F.col("first.place").alias("there"))
    # those of few documents also meet the holders between the first and themselves
    holder = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid", "place", "weight", "next")
    few = held.where(F.col("n").between(3, RARE_DOCS)).groupBy("key").agg(F.sort_array(F.collect_list(holder)).alias("all"))
    later = few.select("all", F.posexplode("all").alias("at", "own")).where("at > 1")
    earlier = later.select("own", F.explode(F.slice("all", F.lit(2), F.col("at") - 1)).alias("other"))
    between = earlier.select(*(F.col(f"own.{c}") for c in match[:4]), F.col("other.uid").alias("partner"), F.col("other.place").alias("there"))
    own = matches.unionByName(between).groupBy("uid").agg(F.collect_list(F.struct(*match[1:])).alias("matches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ms in batch.column(1):
                pairs = []
                for place, weight, after, partner, there in (m.values() for m in ms.as_py()):
                    pairs.append((place, weight, partner, there))
                    if after is not None:
                        pairs.append((place + 1, after, partner, there + 1))
                found.append(doomed_lines(pairs, block_words))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["uid", "doomed"])
            yield out.filter(pa.array(np.array([bool(d) for d in found], bool)))

    return own.mapInArrow(run, "uid long, doomed array<int>")


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with text shortened by the runs of lines that an earlier document has, and `n_deleted`.

    `docs` needs uid (unique, the same on every evaluation), doc_id and text; its other
    columns, whatever their names, are kept as they are; one called n_deleted is replaced.  Earlier is the smaller doc_id, then the smaller uid; null doc_ids come
    last.  Lines compare without surrounding blanks; blank lines neither match nor break
    a run.  The first document of a line always keeps it.  A null text stays null, an empty
    one empty; a text may lose all its lines.  An empty table gives no rows.
    """

    @F.pandas_udf("string")
    def cut(texts, doomed):
        return texts.combine(doomed, lambda t, d: t if d is None else without_lines(t, list(d)))

    cut = cut.asNondeterministic()  # else a filter on the text cuts a second time, in another Python worker of the task
    kept = [c for c in docs.columns if c not in ("text", "n_deleted")]
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in kept)).alias("row")  # whatever its columns are called
    rows = docs.select(F.col("uid").alias("key"), F.col("text").alias("body"), row)
    joined = rows.join(line_deletions(docs, block_words).withColumnRenamed("uid", "key"), "key", "left")
    shortened = F.when(F.col("doomed").isNull(), F.col("body")).otherwise(cut("body", "doomed"))
    columns = (shortened.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "n_deleted")
    return joined.select(*columns, F.coalesce(F.size("doomed"), F.lit(0)).cast("long").alias("n_deleted"))
