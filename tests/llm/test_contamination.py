"""Benchmark decontamination against brute force over words."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadbook.llm import contamination
from leadbook.llm.contamination import KeySet, contaminated, contamination_report, merged, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def brute_force(docs, items, window=10):
    held: dict[tuple[str, ...], set[str]] = {}
    for item_id, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w and item_id is not None else 0):
            held.setdefault(tuple(w[k : k + window]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in held}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in held:
                    hit.update(range(k, k + size))
                    found |= held[key]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def report(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination_report(d, i).drop("spans", "items").collect()
    return sorted((tuple(r) for r in rows), key=str)


def corpus(seed, n_docs=60, n_items=25):
    """Documents over few words, so that shingles repeat, some with (parts of) items, joined by odd marks."""
    rng = random.Random(seed)
    vocabulary = ["ka", "lo", "Mi", "ran", "é", "漢字", "7", "x" * 20]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, " ".join(say(rng.choice([1, 2, 3, 5, 9, 10, 11, 30])))) for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        w = say(rng.randint(0, 60))
        if k % 3 == 0:
            w += items[k % n_items][1].upper().split(" ") + say(3)
        docs.append((k, rng.choice([" ", "\n", ", ", "_", "-"]).join(w)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_report_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert report(spark, docs, items) == brute_force(docs, items)


def test_awkward_rows(spark):
    long_word = "w" * 2000
    items = [
        (1, "one two three"), (1, "four " * 12), (2, "one two three"), (3, None), (4, " .,; "), (None, "alpha beta"), (5, long_word),
        (6, " ".join(f"t{k}" for k in range(30))), (-7, "one two three"),
    ]
    docs = [
        (0, None), (1, ""), (2, "ONE, two; three"), (2, "ONE, two; three"), (None, "four " * 40), (3, "alpha beta"), (4, f"a {long_word} b"),
        (5, f"a {long_word}w b"), (6, " ".join(f"T{k}" for k in range(29))), (7, "one two"), (8, " ".join(["one two three"] * 4000)), (9, "three one two"),
    ]
    assert report(spark, docs, items) == brute_force(docs, items)
    assert report(spark, docs, []) == brute_force(docs, [])
    assert report(spark, [], items) == []


def test_clashing_columns(awkward, spark):
    items = awkward.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("uid"), F.lit(2).alias("words"), F.lit(3).alias("a.b"))
    rows = contamination_report(awkward.withColumn("items", F.lit(0)).withColumn("n_words", F.lit(0)).withColumn("a.b", F.lit(0)), items).collect()
    texts = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((tuple(r)[:6] for r in rows), key=str) == brute_force(texts, texts)


def test_many_blocks_equal_one(spark):
    docs, items = corpus(4)
    shared = [(100 + k, items[7][1]) for k in range(40)]  # one window that most items have
    d = spark.createDataFrame(docs, "doc_id long, text string").select(F.col("doc_id").alias("uid"), "doc_id", "text")
    i = spark.createDataFrame(items + shared, "item_id long, text string")
    one = sorted(map(tuple, contaminated(d, i).collect()))
    many = sorted(map(tuple, contaminated(d, i, windows_per_block=30, keys_per_block=20).collect()))
    assert one == many and any(r[4] for r in one)


def test_slices_and_candidate_parts(spark, monkeypatch):
    docs, items = corpus(5, 12, 10)
    table = contamination._slices
    monkeypatch.setattr(contamination, "SLICE_BYTES", 100)
    monkeypatch.setattr(contamination, "PAIRS_AT_ONCE", 7)
    import pyarrow as pa

    column = pa.array([None] + [t for _, t in docs]).slice(1)
    rows = [(row, to) for row, to, _ in table(column)]
    assert rows[0][0] == 0 and rows[-1][1] == len(docs) and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    found = [w.data[a:b].tobytes().decode() for _, _, w in table(column) for a, b in zip(w.start, w.end)]
    assert found == [x for _, t in docs for x in words(t)]
    held = sorted({(" ".join(w[k : k + 10])) for _, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))})
    rows = [(t, int(contamination.shingle_keys(words_of(np.frombuffer(t.encode(), np.uint8).copy(), np.array([0, len(t.encode())])).hash, min(3, t.count(" ") + 1))[0].view(np.int64)), 0, ["i"]) for t in held]
    block = contamination.Windows.of(rows)
    for row, to, w in table(column):
        begin, window = block.found_in(w)
        got = sorted((int(w.text[b]) + row, held.index(block.text[k].decode())) for b, k in zip(begin, window))
        want = sorted((r, h) for r in range(row, to) for h, t in enumerate(held) for k in range(len(words(docs[r][1]))) if words(docs[r][1])[k : k + t.count(" ") + 1] == t.split(" "))
        assert got == want


def test_key_set_finds_what_it_holds():
    keys = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2)
    where, at = KeySet(keys[:500]).find(keys)
    assert where.tolist() == list(range(500)) and (np.sort(keys[:500])[at] == keys[:500]).all()
    assert len(KeySet(keys[:0]).find(keys)[0]) == 0


def test_spans_merge():
    spans = [{"start": 0, "end": 3}, {"start": 2, "end": 5}, {"start": 5, "end": 6}, {"start": 9, "end": 10}]
    assert merged(spans) == [{"start": 0, "end": 6}, {"start": 9, "end": 10}]
