"""Fingerprints, Jaccard groups and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from leadbook.llm.components import components
from leadbook.llm.fingerprints import as_text, combine, edited_fingerprints, paragraph_vectors
from leadbook.llm import jaccard
from leadbook.llm.jaccard import Bands, block_keys, narrowed, shingles, similarity_groups, sketch_of
from leadbook.llm.lines import aligned, dedup_lines, doomed_lines
from leadbook.llm.successors import range_of, range_starts
from tests.llm.conftest import SCHEMA, prose, rows_of


def numbered(df):
    return df.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")


# --- fingerprints -----------------------------------------------------------------


def test_edited_texts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 60)) + "é漢" * (k % 3) for k in range(300)]
    ids = rng.sample(range(-500, 5000), 300)
    rows = edited_fingerprints(spark.createDataFrame(rows_of(texts, ids), SCHEMA)).collect()
    order = sorted(zip(ids, texts))
    for k, (doc_id, text) in enumerate(order):
        row = next(r for r in rows if r.doc_id == doc_id)
        half = len(text) // 2
        edited = text[: len(text) - half] + order[(k + 1) % len(order)][1][:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.2


def fingerprint_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    v = paragraph_vectors(df, ["k"], "t").select("k", as_text(F.col("check"), F.col("pairs"), F.col("triples")).alias("f"))
    return [r.f for r in v.orderBy("k").collect()]


def test_fingerprints_add_up(spark):
    a, b, both, turned = fingerprint_of(spark, ["x y z\nu v", "p q", "x y z\nu v\np q", "p q\nu v\nx y z"])
    assert both == turned != a
    pair = spark.createDataFrame([(a, b, both)], "a string, b string, c string")
    added = pair.select(combine(F.col("a"), F.col("b")).alias("s"), combine(F.col("c"), F.col("b"), -1).alias("d")).first()
    assert (added.s, added.d) == (both, a)


def test_fingerprints_of_awkward_rows(awkward, no_documents):
    rows = edited_fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    same = {r.fingerprint for r in rows if r.doc_id is not None and texts[r.doc_id] == texts[3]}
    assert len(same) == 1 and sum(r.fingerprint in same for r in rows) == 3
    alone = [r for r in rows if r.doc_id is None]
    assert [r.near_next for r in alone] == [0.0, 0.0]
    assert edited_fingerprints(no_documents).count() == 0


def test_one_document_follows_itself(spark):
    row = edited_fingerprints(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0


def test_ranges_hold_the_ids(spark):
    ids = [random.Random(4).randint(-(10**12), 10**12) for _ in range(3000)] + list(range(2000))
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    starts = range_starts(df, "doc_id", rows_per_range=5)
    assert len(starts) > 300 and starts[0] == min(ids)
    found = df.select("doc_id", range_of(F.col("doc_id"), starts).alias("r")).collect()
    assert all(r.r == np.searchsorted(starts, r.doc_id, "right") - 1 for r in found)


# --- Jaccard ----------------------------------------------------------------------


def word_sets(texts, words):
    out = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return out


def leads(sets, ids, num, den):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = sorted((find(i), find(j)), key=lambda k: ids[k])
                parent[y] = x
    return [min(ids[k] for k in range(len(ids)) if find(k) == find(i)) for i in range(len(ids))]


def edited_copies(rng, bases, copies):
    texts = []
    for _ in range(bases):
        words = prose(rng, rng.randint(3, 150)).split()
        for _ in range(rng.randint(1, copies)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = prose(rng, 1)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def test_groups_equal_brute_force(spark):
    for words, num, den, seed in ((3, 90, 100, 1), (5, 8, 10, 2), (1, 1, 2, 3)):
        texts = [*edited_copies(random.Random(seed), 60, 8), "", None, "a", "A", "a b", " \t"]
        ids = random.Random(seed).sample(range(10_000), len(texts))
        docs = numbered(spark.createDataFrame(rows_of(texts, ids), SCHEMA))
        rows = {r.doc_id: r for r in similarity_groups(docs, words, num, den).collect()}
        sets = word_sets(texts, words)
        expected = leads(sets, ids, num, den)
        assert {i: rows[i].n_shingles for i in ids} == dict(zip(ids, map(len, sets)))
        assert {i: rows[i].lead_id for i in ids} == dict(zip(ids, expected))


def test_a_chain_in_one_group_is_found_whole(spark):
    """Near copies that are linked only along a chain, whatever pivot is met first."""
    rng = random.Random(9)
    chain, texts = prose(rng, 400).split(), []
    for k in range(30):
        for j in range(5):
            chain[(k * 13 + j) % 400] = f"new{k}-{j}"
        texts.append(" ".join(chain))
    docs = numbered(spark.createDataFrame(rows_of(texts), SCHEMA))
    got = {r.doc_id: r.lead_id for r in similarity_groups(docs, 3, 90, 100).collect()}
    assert list(got[k] for k in range(30)) == leads(word_sets(texts, 3), list(range(30)), 90, 100)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (8, 10)):
        bands = Bands(num, den)
        for size in [9, 10, 12, 19, 20, 50, 100, 333, 2000]:
            for _ in range(20):
                full = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                gone = rng.integers(0, bands.difference(len(full), len(full)) // 2 + 1)
                other = np.unique(np.concatenate([full[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)]))
                common = len(np.intersect1d(full, other))
                if den * common >= num * (len(full) + len(other) - common) and len(full) >= bands.lowest():
                    assert np.intersect1d(block_keys(full, bands), block_keys(other, bands)).size


def test_a_narrowed_sketch_is_that_of_fewer_bits(monkeypatch):
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**63, 5_000, dtype=np.uint64))
    wide = sketch_of(hashes)
    assert len(wide) == 8_192 // 8 and len(sketch_of(hashes[:1])) == len(sketch_of(hashes[:1024])) == 128
    monkeypatch.setattr(jaccard, "MOST_SKETCH_BITS", 2_048)
    assert narrowed(wide, 256).tobytes() == sketch_of(hashes)
    assert narrowed(wide, len(wide)).tobytes() == wide


def test_sketches_hold_long_texts_apart(spark, monkeypatch):
    """Long texts that share a passage are no candidates; those that are alike are, from sketches of two widths."""
    compared = []
    similar = jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda pairs, *rest: (compared.append(pairs.count()), similar(pairs, *rest))[1])
    rng = random.Random(4)
    shared = prose(rng, 300)
    texts = [f"{shared} {' '.join(str(rng.random()) for _ in range(3_000))}" for _ in range(40)]
    near = [str(rng.random()) for _ in range(1_100)]
    texts += [" ".join(near), " ".join(near[:1_000])]
    got = {r.doc_id: r.lead_id for r in similarity_groups(numbered(spark.createDataFrame(rows_of(texts), SCHEMA)), 5, 8, 10).collect()}
    assert got == {**{k: k for k in range(40)}, 40: 40, 41: 40}
    assert sum(compared) == 1


def test_similar_sets_share_one_of_their_rarest_keys():
    """Whatever the order of the keys: without all but one of those that it must share, a set still meets its like."""
    rng = np.random.default_rng(8)
    for num, den in ((8, 10), (90, 100), (5, 10)):
        bands = Bands(num, den)
        for n in (3, 6, 20, 90, 400, 1_500):
            for _ in range(40):
                full = np.unique(rng.integers(0, 2**64, n, np.uint64))
                other = full[rng.permutation(len(full))[: -(-len(full) * num // den)]]
                if len(other) == len(full):
                    continue
                (keys, least), (others, theirs) = (jaccard.sketch_blocks(np.sort(x), bands) for x in (full, other))
                order = int(rng.integers(1, 2**62)) | 1
                band = theirs[0][0]  # that of the smaller set
                kept = []
                for found, must in ((keys, dict(least)), (others, dict(theirs))):
                    own = found[found >> np.uint64(56) == band]
                    own = own[np.argsort(own * np.uint64(order))]
                    kept.append(own[: len(own) - must[band] + 1])
                assert np.intersect1d(*kept).size


def test_chance_keys_are_not_dealt(spark, monkeypatch):
    """Texts that share single n-grams meet in no group; later rounds deal only the sets that the first found alike."""
    rows, real = {}, jaccard.stage

    def counted(df, label, *rest):
        out = real(df, label, *rest)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    rng = random.Random(9)
    common = [" ".join(f"c{k}w{i}" for i in range(5)) for k in range(12)]
    texts = []
    for _ in range(60):
        words = [str(rng.random()) for _ in range(300)]
        for at, passage in enumerate(common):
            words.insert(at * 25, passage)
        texts.append(" ".join(words))
    base = [str(rng.random()) for _ in range(200)]
    texts += [" ".join(base[: 200 - k]) for k in range(6)]
    got = {r.doc_id: r.lead_id for r in similarity_groups(numbered(spark.createDataFrame(rows_of(texts), SCHEMA)), 5, 8, 10).collect()}
    assert got == {**{k: k for k in range(60)}, **dict.fromkeys(range(60, 66), 60)}
    asked = real(jaccard.sketched(numbered(spark.createDataFrame(rows_of(texts[:60]), SCHEMA)), 5, Bands(8, 10), 8), "asked")
    shared = asked.where("part is not null").groupBy("part").applyInPandas(jaccard._shared_keys, "key long, chunk long, place int, uses long")
    assert shared.count() > 0
    assert jaccard._rarest(shared, asked.where("part is null")).count() == 0
    assert set(rows["met-blocks"]) and all(n <= rows["groups"][0] for n in rows["groups"])


def test_shingles_of_short_texts():
    assert len(shingles("", 3)) == len(shingles(" \n", 3)) == len(shingles(None, 3)) == 0
    assert len(shingles("a b", 3)) == len(shingles("a b c", 3)) == 1
    assert shingles("A b", 3).tolist() == shingles("a B", 3).tolist() != shingles("a b b", 3).tolist()


def test_groups_of_awkward_rows(awkward, no_documents):
    rows = similarity_groups(numbered(awkward), 5, 8, 10).collect()
    assert len(rows) == awkward.count()
    assert len({r.lead_uid for r in rows if r.lead_id == 3}) == 1 and sum(r.lead_id == 3 for r in rows) == 4
    assert similarity_groups(numbered(no_documents), 5, 8, 10).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 99)] + [(200, 201), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {**dict.fromkeys(range(1, 100), 0), 201: 200}
    assert components(links.limit(0)).count() == 0


# --- lines ------------------------------------------------------------------------


def test_patience_alignment():
    assert aligned([]) == []
    assert aligned([(0, 5), (1, 0), (2, 1), (3, 9), (4, 2)]) == [1, 2, 4]
    assert doomed_lines([(0, 4, 1, 0), (1, 4, 1, 1), (2, 4, 1, 2), (7, 4, 1, 3)], 10) == [0, 1, 2]


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, 1, text, 5, 6, 7, 8), (2, 2, text + "\nend", 5, 6, 7, 9)]
    docs = spark.createDataFrame(rows, ["uid", "doc_id", "text", "__uid", "doomed", "a.b`c", "n_deleted"])
    got = dedup_lines(docs)
    assert got.columns == ["uid", "doc_id", "text", "__uid", "doomed", "a.b`c", "n_deleted"]
    assert [tuple(r) for r in got.orderBy("uid").collect()] == [(1, 1, text, 5, 6, 7, 0), (2, 2, "end", 5, 6, 7, 1)]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    passages = [[prose(rng, 12) for _ in range(rng.randint(1, 5))] for _ in range(8)]
    texts = []
    for _ in range(80):
        parts = [[prose(rng, rng.randint(1, 9))] for _ in range(3)] + [rng.choice(passages) for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        texts.append("\n".join(line for p in parts for line in p))
    docs = numbered(spark.createDataFrame(rows_of(texts), SCHEMA))
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    first: dict = {}
    for k, text in enumerate(texts):
        seen: dict = {}
        matches = []
        for place, line in enumerate(text.split("\n")):
            n = seen[line] = seen.get(line, 0) + 1
            holder = first.setdefault((line, n), (k, place))
            if holder[0] != k:
                matches.append((place, line.count(" ") + 1, *holder))
        doomed = set(doomed_lines(matches))
        assert got[k].text == "\n".join(line for p, line in enumerate(text.split("\n")) if p not in doomed)
        assert got[k].n_deleted == len(doomed)
    kept = "\n".join(r.text for r in got.values()).split("\n")
    most = {line: max(t.split("\n").count(line) for t in texts) for p in passages for line in p}
    assert all(kept.count(line) == n for line, n in most.items())
    assert all(line in kept for text in texts for line in text.split("\n"))


def test_line_dedup_of_awkward_rows(awkward, no_documents):
    rows = dedup_lines(awkward.drop("uid").withColumn("uid", F.monotonically_increasing_id())).collect()
    assert len(rows) == awkward.count() and set(awkward.columns) <= set(rows[0].asDict())
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 7)}
    assert by[0].text is None and by[1].text == "" and by[2].n_deleted == 0
    assert by[5].text == "" and by[3].n_deleted == 0 and 0 < by[4].n_deleted < 6
    assert by[6].n_deleted == 0 and len(by[6].text) > 100_000
    assert dedup_lines(numbered(no_documents)).count() == 0


def test_short_lines_of_many_documents_go(spark):
    rng = random.Random(7)
    notice, passage = "Read our terms of use here.", ["这是一个关于大桥维修工程的长篇报道的第一段", "第二段说明了道路何时重新开放以及原因"]
    texts = ["\n".join([prose(rng, 20), notice, prose(rng, 20)]) for _ in range(8)]
    texts += ["\n".join([prose(rng, 20), "Twice by chance, no more.", prose(rng, 20)]) for _ in range(2)]
    texts += ["\n".join([prose(rng, 20), *passage]) for _ in range(2)]
    got = [r.text for r in sorted(dedup_lines(numbered(spark.createDataFrame(rows_of(texts), SCHEMA))).collect(), key=lambda r: r.doc_id)]
    assert [notice in t for t in got[:8]] == [True] + [False] * 7
    assert all("Twice by chance" in t for t in got[8:10])
    assert passage[0] in got[10] and not any(line in got[11] for line in passage)


def test_lines_align_with_any_earlier_document(spark):
    rng = random.Random(8)
    x, y, z, v, w, first = (prose(rng, 6) for _ in range(6))
    long = [prose(rng, 12) for _ in range(3)]
    orders = [[z, y, x], [x, y, z], [x, y, z], [v, w, first], [v, prose(rng, 6), v, w, first]]
    # lines far from each other, the first document has them in another order
    apart = lambda ls: [line for own in ls for line in (own, prose(rng, 3))]
    orders += [apart(long[::-1]), apart(long), apart(long)]
    texts = ["\n".join(lines) for lines in orders]
    got = [r.text for r in sorted(dedup_lines(numbered(spark.createDataFrame(rows_of(texts), SCHEMA))).collect(), key=lambda r: r.doc_id)]
    assert got[0] == texts[0] and got[2] == "" and got[3] == texts[3]
    assert got[4].split("\n") == orders[4][:2]
    assert got[5] == texts[5] and got[7].split("\n") == orders[7][1::2]
    assert aligned([(0, 0), (1, 0), (1, 3), (2, 1)]) in ([0, 2], [1, 2])
