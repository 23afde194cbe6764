"""The Merkle manifest against a plain recursion over lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from leadbook.llm import merkle
from leadbook.llm.merkle import build_manifest, document_proofs, follow, hash_up, height_of, joined_digest, manifest_records, segment_levels
from leadbook.runtime import stage
from tests.llm.conftest import rows_of

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fan_out):
    """The top of a run of digests, and per node its path as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            lo = p // fan_out * fan_out
            paths[k].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + fan_out])))
        nodes = [digest(*nodes[k : k + fan_out]) for k in range(0, len(nodes), fan_out)]
        at = [p // fan_out for p in at]
    return nodes[0], paths


def brute_force(rows, fan_out=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    out, subroots, below = [], [], []
    for lang in langs:
        mine = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        top, paths = climb([leaf_of(r) for r in mine], fan_out)
        subroots.append(top)
        below.append((mine, paths))
    root, upper = climb(subroots, fan_out) if subroots else (None, [])
    for subroot, above, (mine, paths) in zip(subroots, upper, below):
        for row, path in zip(mine, paths):
            path = path + above
            doc_id, source, lang, n_chars, text = row
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
            h = leaf_of((doc_id, source, lang, n_chars + 1, text) if bad else row)
            for before, after in path:
                h = digest(before, h, after)
            out.append((doc_id, leaf_of(row), subroot, root, digest(*(b + a for b, a in path)), h, h == root))
            assert (h != root) == bad
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in document_proofs(df, **options).drop("path").collect()), key=str)


def corpus(n, langs):
    return [(k * 13 % 1009 - 50, None if k % 5 else "src", langs[k * k % len(langs)], None if k % 11 == 0 else k, f"té xt {k}" * (k % 4)) for k in range(n)]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en", None]), (9, ["a", "Z", "é", "", None]), (700, ["en"] * 5 + ["de", "fr", None])])
def test_proofs_equal_brute_force(spark, n, langs):
    rows = corpus(n, langs)
    assert got(spark.createDataFrame(rows, FIELDS)) == brute_force(rows)


@pytest.mark.parametrize("fan_out,leaves", [(2, 4), (3, 9), (3, 4), (5, 2)])
def test_many_segments_and_wider_runs(spark, monkeypatch, fan_out, leaves):
    monkeypatch.setattr(merkle, "SEGMENT_LEAVES", leaves)
    rows = corpus(120, ["en", "en", "en", "de", "x", "y", "z", None])
    assert got(spark.createDataFrame(rows, FIELDS), fan_out=fan_out) == brute_force(rows, fan_out)


def test_awkward_rows(awkward, no_documents, spark):
    more = awkward.withColumn("rank", F.lit(1)).withColumn("path", F.lit("p")).withColumn("digest", F.lit("d")).withColumn("a.b", F.lit(0))
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in awkward.collect()]
    assert got(more) == brute_force(rows)
    assert got(no_documents) == []
    twice = rows_of(["same"] * 600, [7] * 600)  # one row repeated: equal leaves, equal bundles
    plain = [(r[0], r[3], "en", r[4], r[1]) for r in twice]
    assert got(spark.createDataFrame(plain, FIELDS)) == brute_force(plain)


def test_records_lead_from_the_root_to_every_leaf(spark):
    rows = corpus(300, ["en", "en", "de"])
    df = spark.createDataFrame(rows, FIELDS)
    leaves = stage(df.select("doc_id", "lang", joined_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("digest")), "leaves")
    manifest = build_manifest(leaves, "lang", ["doc_id"])
    held = {r["digest"]: r["children"] for r in manifest_records(manifest).collect()}
    assert all(digest(*children) == d and 1 <= len(children) <= 2 for d, children in held.items())
    reach, wanted = [], [manifest.top.roots.first()["digest"]]
    while wanted:
        at = wanted.pop()
        wanted += held.get(at, [])
        reach += [] if at in held else [at]
    assert sorted(reach) == sorted(leaf_of(r) for r in rows)


def test_a_path_answers_each_rank():
    leaves = [digest(str(k)) for k in range(11)]
    top, records = hash_up(leaves, height_of(11, 3), 3)
    want, paths = climb(leaves, 3)
    assert top == want and segment_levels(3) == 5
    for k in range(11):
        end, steps = follow(top, dict(records), k, height_of(11, 3), 3)
        assert end == leaves[k] and [(s["before"], s["after"]) for s in steps[::-1]] == paths[k]
