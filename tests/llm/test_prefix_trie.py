"""The prefix trie of conversations against nested dictionaries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from leadbook.llm import prefix_trie as module
from leadbook.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth long, pos int, words string"


def order_of(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())


def brute_force(rows):
    own = {}
    for row in sorted((r for r in rows if r[0] is not None), key=order_of):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    child, leaves, saved = {}, {}, {}
    for key, members in nodes.items():
        if key:
            child[key[:-1]] = child.get(key[:-1], 0) + 1
    for key, members in nodes.items():
        value = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            saved[key[:d]] = saved.get(key[:d], 0) + value
            leaves[key[:d]] = leaves.get(key[:d], 0) + (key not in child)
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(key), parent, len(members), child.get(key, 0), leaves[key], saved[key], digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in prefix_trie(df).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, "w") for r in rows], SCHEMA)


def corpus(seed, n, turns):
    """Conversations over few different turns, so that prefixes are shared; numbers with gaps."""
    rng = random.Random(seed)
    said = ["a b", "c", None, "", "é d\te\n", "x " * 9]
    rows = []
    for c in rng.sample(range(3 * n), n):
        rows += [(c, k, rng.choice(["user", None]), rng.choice(said[: 1 + k % 6])) for k in range(rng.randint(1, turns))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,turns", [(1, 1, 1), (2, 60, 4), (3, 150, 9)])
def test_trie_equals_brute_force(spark, seed, n, turns):
    rows = corpus(seed, n, turns)
    assert got(table(spark, rows)) == brute_force(rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "IDS_PER_CHUNK", 7)
    rows = [(5, None, "user", "first"), (5, None, "user", "first"), (5, 1, None, None), (None, 0, "user", "nobody"), (5, 1, "", "")]
    rows += [(c, k, "user", f"t{k}") for c in range(100, 160) for k in range(3)]  # copies, among them heads of twenty
    rows += [(161, k, "user", f"turn {k % 7}") for k in range(70)]  # a long conversation, whose head is absent or short
    rows += [(7, 3, "x", "y" * 5000), (40, 1, "user", "only"), (41, 1, "user", "one"), (42, 1, "user", "one"), (43, 1, "user", "one")]
    assert got(table(spark, rows)) == brute_force(rows)
    assert got(table(spark, [])) == []
    assert got(table(spark, [(None, 0, "user", "nobody")])) == []
    alone = [(c, 0, "user", "gone") for c in range(1, 20)]  # no heads: those that drop their only turn end at the root
    assert got(table(spark, alone)) == brute_force(alone)


def test_extra_columns_with_odd_names(spark):
    rows = corpus(4, 20, 3)
    df = table(spark, rows).withColumn("a.b", F.lit(0)).withColumn("__at", F.lit(0))
    assert got(df) == brute_force(rows)
