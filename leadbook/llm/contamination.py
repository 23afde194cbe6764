"""Benchmark decontamination: which words of a document stand in a window of a benchmark item.

A prefix-filtered set join.  A window (some consecutive item words) is the set of its
shingles, up to three words long, ordered by how rare they are in the documents.  For
exact containment the necessary prefix is the rarest shingle alone: a document without
it cannot hold the window, and a window with a shingle that no document has is dropped
at once.  Documents are matched on prefix shingles; the shingle's place in the window
says where the window would begin, which must lie inside the document (length and
position), and all words are then compared.

Documents are never shuffled: windows travel, in blocks of bounded size, one pass over
the documents each, so a passage that a third of all documents hold is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.llm.worker_cache import release
from leadbook.runtime import discard, stage

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
# Bounds of what one pass sends to every worker: shingle keys, or windows and their items.
KEYS_PER_BLOCK = 2_000_000
WINDOWS_PER_BLOCK = 400_000
BYTES_PER_BLOCK = 64_000_000
# Text that a worker cuts into words at a time; a longer text is a slice of its own.
SLICE_BYTES = 8_000_000
# Candidates that are compared at a time.
PAIRS_AT_ONCE = 1_000_000
# Longer words are hashed one by one.
_LONG_WORD = 512

MATCHES = "uid long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_MATCHES_ARROW = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
])

# Bytes of UTF-8: digits, small letters and everything beyond ASCII are word bytes.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return (h ^ (h >> np.uint64(29))) * _B


@dataclass(frozen=True)
class Words:
    """Words of several texts: where their bytes are, a hash of each, and the text they are in."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts that lie side by side in `data`, text k from offsets[k] to offsets[k + 1]."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (cut[:-1] | ~inside[:-2]))
    end = np.flatnonzero(inside[1:-1] & (cut[1:] | ~inside[2:])) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, text, _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time over all words that still have bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    size = end - start
    out = _mix(size.astype(np.uint64) * _A + _B)
    live, done = np.flatnonzero(size <= _LONG_WORD), 0
    while len(live):
        rest = size[live] - done
        out[live] = _mix(out[live] ^ (eight[start[live] + done] & _FIRST_BYTES[np.minimum(rest, 8)]))
        live, done = live[rest > 8], done + 8
    for k in np.flatnonzero(size > _LONG_WORD):
        out[k] = int.from_bytes(blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A key for every run of `size` words; runs of different sizes have different keys."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out ^ words[k : k + n])
    return out


class KeySet:
    """Sorted keys, with a bitmap in front that answers most lookups."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.shift = np.uint64(64 - min(24, max(10, len(keys).bit_length() + 4)))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `keys` are in the set, and where."""
        maybe = np.flatnonzero(self.bitmap[keys >> self.shift])
        at = np.searchsorted(self.keys, keys[maybe])
        good = self.keys[np.minimum(at, len(self.keys) - 1)] == keys[maybe] if len(self.keys) else np.zeros(0, bool)
        return maybe[good], at[good]


@dataclass(frozen=True)
class Windows:
    """A block of distinct windows, sorted by prefix key, and the items that have each."""

    keys: KeySet  # distinct prefix keys
    first: np.ndarray  # windows of key k: first[k] to first[k + 1]
    place: np.ndarray  # of the prefix shingle in its window
    size: np.ndarray
    words: np.ndarray  # hashes, one row a window, zeros behind its last word
    text: list[bytes]  # the words themselves, a blank between them
    items: list[list[str]]

    @classmethod
    def of(cls, rows: list[tuple[str, int, int, list[str]]]) -> Windows:
        """From (window, prefix key, place, items) of distinct windows."""
        rows = sorted(rows, key=lambda r: (r[1] % 2**64, r[0]))
        text = [r[0].encode() for r in rows]
        offsets = np.cumsum([0, *map(len, text)])
        cut = words_of(np.frombuffer(bytearray(b"".join(text)), np.uint8), offsets)
        size = np.bincount(cut.text, minlength=len(rows)).astype(np.int64)
        words = np.zeros((len(rows), int(size.max(initial=0))), np.uint64)
        words[cut.text, np.arange(len(cut.text)) - (np.cumsum(size) - size)[cut.text]] = cut.hash
        keys = np.array([r[1] % 2**64 for r in rows], np.uint64)
        distinct, first = np.unique(keys, return_index=True)
        return cls(KeySet(distinct), np.append(first, len(rows)), np.array([r[2] for r in rows], np.int64), size, words, text, [r[3] for r in rows])

    def found_in(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of every occurrence."""
        begins, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in np.unique(np.minimum(self.size, SHINGLE_WORDS)):
            at, key = self.keys.find(shingle_keys(words.hash, int(size)))
            many = self.first[key + 1] - self.first[key]
            cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS_AT_ONCE, many.sum(), PAIRS_AT_ONCE))
            for part in np.split(np.arange(len(at)), cuts):
                n = many[part]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window = np.repeat(self.first[key[part]], n) + inner
                begin, window = self._verified(words, np.repeat(at[part], n) - self.place[window], window)
                begins.append(begin)
                windows.append(window)
        return np.concatenate(begins), np.concatenate(windows)

    def _verified(self, words: Words, begin: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = begin + self.size[window] - 1
        fits = (begin >= 0) & (last < len(words.text))  # positional bound
        begin, window, last = begin[fits], window[fits], last[fits]
        fits = words.text[begin] == words.text[last]  # length bound: the text has room for the window
        begin, window = begin[fits], window[fits]
        for k in range(self.words.shape[1]):
            same = (self.size[window] <= k) | (words.hash[np.minimum(begin + k, len(words.hash) - 1)] == self.words[window, k])
            begin, window = begin[same], window[same]
        end = words.end[begin + self.size[window] - 1]
        exact = [
            b" ".join(_WORD.findall(words.data[a:b].tobytes())) == self.text[w]
            for a, b, w in zip(words.start[begin].tolist(), end.tolist(), window.tolist())
        ]
        exact = np.array(exact, bool)
        return begin[exact], window[exact]


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row behind the last, words) of slices of a text column; a null text has no words."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, to, words_of(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to


def item_windows(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (window, item) of items (item_id, text): every run of `window` words, or all words of a shorter item.

    Items are named by their id as text; rows that repeat an id are one item.  Rows
    without an id or without words have no windows.
    """
    big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), big, small), F.lit(_SQL_WORD), F.lit(0))
    cut = items.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where("item IS NOT NULL AND size(words) > 0")
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    placed = cut.select("item", "words", F.explode(places).alias("place"))
    return placed.select(F.array_join(F.slice("words", F.col("place"), F.lit(window)), " ").alias("window"), "item").distinct()


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window, key, place) of every shingle of distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, words in _slices(batch.column(0)):
                count = np.bincount(words.text)
                sizes = np.minimum(count, SHINGLE_WORDS)
                texts, keys, places = [], [], []
                for size in np.unique(sizes[sizes > 0]):
                    at = np.arange(len(words.text) - size + 1)
                    at = at[(words.text[at] == words.text[at + size - 1]) & (sizes[words.text[at]] == size)]
                    keys.append(shingle_keys(words.hash, int(size))[at])
                    texts.append(words.text[at])
                    places.append(at - (np.cumsum(count) - count)[words.text[at]])
                if texts:
                    picked = batch.column(0).take(pa.array(np.concatenate(texts) + row))
                    yield pa.RecordBatch.from_arrays(
                        [picked, pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places))], ["window", "key", "place"]
                    )

    return windows.mapInArrow(run, "window string, key long, place long")


def _blocks_for(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _key_counts(docs: DataFrame, keys: DataFrame, per_block: int) -> DataFrame:
    """(key, n): how often the documents (uid, text) have each of the keys, one pass a block of them."""
    spark, parts = docs.sparkSession, []
    blocks = _blocks_for(keys.count(), per_block)
    for block in range(blocks):
        mine = keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        # At most about `per_block` keys of eight bytes.
        sent = spark.sparkContext.broadcast(mine.toArrow().column("key").to_numpy().view(np.uint64))
        seen = docs.select("text").mapInArrow(_counter(sent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        parts.append(stage(seen, "shingle-counts"))
    return reduce(DataFrame.unionByName, parts)


def _counter(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the keys that were sent in a task's texts: one row a key and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = KeySet(sent.value)
        n = np.zeros(len(known.keys), np.int64)
        for batch in batches:
            for _, _, words in _slices(batch.column(0)):
                for size in range(1, SHINGLE_WORDS + 1):
                    n += np.bincount(known.find(shingle_keys(words.hash, size))[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(known.keys[some].view(np.int64)), pa.array(n[some])], ["key", "n"])

    return run


def _with_prefix(windows: DataFrame, shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, item, key, place) of the windows that the documents may hold, with their rarest shingle."""
    counted = shingles.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("window").agg(F.min(F.struct("n", "key", "place")).alias("p")).where("p.n > 0")
    return windows.join(rarest, "window").select("window", "item", "p.key", "p.place")


def _matches(docs: DataFrame, rows: list[tuple[str, int, int, list[str]]]) -> DataFrame:
    """Rows of MATCHES for all documents (uid, doc_id, text) and one block of windows."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        block = Windows.of(sent.value)
        for batch in batches:
            for row, to, words in _slices(batch.column(2)):
                ids = [batch.column(c).slice(row, to - row) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, *_answers(to - row, words, block)], schema=_MATCHES_ARROW)

    return docs.select("uid", "doc_id", "text").mapInArrow(run, MATCHES)


def _answers(texts: int, words: Words, block: Windows) -> list[pa.Array]:
    """n_words, spans and items of so many texts."""
    begin, window = block.found_in(words)
    n_words = np.bincount(words.text, minlength=texts)
    first = np.cumsum(n_words) - n_words
    # Hit words: one up where a window begins, one down behind its end.
    depth = np.zeros(len(words.text) + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + block.size[window], -1)
    hit = np.cumsum(depth)[:-1] > 0
    start = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (words.text[1:] != words.text[:-1])))
    end = np.flatnonzero(hit & np.append(~hit[1:] | (words.text[1:] != words.text[:-1]), True)) + 1
    spans: dict[int, list[dict]] = {}
    for t, a, b in zip(words.text[start].tolist(), start.tolist(), end.tolist()):
        spans.setdefault(t, []).append({"start": int(a - first[t]), "end": int(b - first[t])})
    items: dict[int, set[str]] = {}
    for t, w in sorted(set(zip(words.text[begin].tolist(), window.tolist()))):
        items.setdefault(t, set()).update(block.items[w])
    return [
        pa.array(n_words),
        pa.array([spans.get(t, []) for t in range(texts)], _MATCHES_ARROW.field("spans").type),
        pa.array([sorted(items.get(t, ())) for t in range(texts)], pa.list_(pa.string())),
    ]


def contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, windows_per_block: int = WINDOWS_PER_BLOCK, keys_per_block: int = KEYS_PER_BLOCK
) -> DataFrame:
    """(uid, doc_id, n_words, spans, items) of every document of (uid, doc_id, text) against items (item_id, text).

    `spans` are the runs of words, from `start` to before `end`, that stand in an
    occurrence of a window of `window` words (an item of fewer, but not none, is one
    window); `items` the sorted ids, as text, of the items with such windows.  A-Z count
    as a-z, and a word is a run of ASCII letters, digits and characters beyond ASCII.  A
    null or empty text has no words.  Repeated rows are judged each for itself, repeated
    items are one; without items no word is hit.  Other columns are ignored.

    Windows are dealt by hash of window and item, so that blocks are bounded even when
    most items share a window; with several blocks, the rows of documents with hits are
    brought together by uid.
    """
    windows = stage(item_windows(items, window), "item-windows")
    shingles = stage(_window_shingles(windows.select("window").distinct()), "window-shingles")
    counts = _key_counts(docs, shingles.select("key").distinct(), keys_per_block)
    chosen = stage(_with_prefix(windows, shingles, counts), "prefixes")
    discard(windows, shingles)
    sizes = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0)).alias("b")).first()
    blocks = max(_blocks_for(sizes["n"], windows_per_block), _blocks_for(sizes["b"], BYTES_PER_BLOCK))
    found = [_matches(docs, _collected(chosen, block, blocks)) for block in range(blocks)]
    if blocks == 1:
        return found[0]
    return _together([stage(f.where("size(spans) > 0") if k else f, "matches") for k, f in enumerate(found)])


def _collected(chosen: DataFrame, block: int, blocks: int) -> list[tuple[str, int, int, list[str]]]:
    """The distinct windows of a block with their items, for the driver to send: bounded by the number of blocks."""
    mine = chosen.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block)
    table = mine.groupBy("window", "key", "place").agg(F.collect_list("item").alias("items")).toArrow()
    return list(zip(*(table.column(c).to_pylist() for c in ("window", "key", "place", "items"))))


def _together(parts: list[DataFrame]) -> DataFrame:
    """One row per uid from the rows of several blocks."""
    sums = reduce(DataFrame.unionByName, parts).groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([merged(x) for x in batch.column("spans").to_pylist()], _MATCHES_ARROW.field("spans").type)
            yield batch.set_column(3, _MATCHES_ARROW.field("spans"), spans)

    return sums.mapInArrow(run, MATCHES)


def merged(spans: list[dict]) -> list[dict]:
    """Sorted spans with those that touch or overlap as one."""
    out: list[dict] = []
    for span in spans:
        if out and span["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], span["end"])
        else:
            out.append(dict(span))
    return out


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans and items."""
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return contaminated(rows, items, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "items",
    )
