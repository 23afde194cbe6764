"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from leadbook.llm import tokenizing
from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, prose, rows_of

STEPS = dict(corpus_pipeline.STAGES)


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "best-fit packing"]


def test_language_stage_keeps_texts_with_letters(spark, awkward):
    out = STEPS["language ID"](spark, awkward, "")
    assert out.columns == awkward.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(r.text for r in awkward.collect() if r.text and any(c.isalpha() for c in r.text))
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert STEPS["language ID"](spark, unlabelled, "").count() == out.count()


def test_line_stage_cuts_and_counts(spark):
    rng = random.Random(1)
    passage = "\n".join(prose(rng, 20) for _ in range(4))
    texts = [prose(rng, 30) + "\n" + passage, passage + "\n" + prose(rng, 5), passage, None, "", prose(rng, 40)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in STEPS["line dedup"](spark, docs, "").collect()}
    assert set(got) == {0, 1, 3, 4, 5}
    assert got[0].text == texts[0] and got[5].text == texts[5] and got[3].text is None and got[4].text == ""
    assert got[1].text == texts[1][len(passage) + 1 :] and got[1].n_chars == len(got[1].text)
    assert got[0].uid == "x" and STEPS["line dedup"](spark, docs, "").columns == docs.columns


def test_group_stage_keeps_the_first_of_each_group(spark):
    rng = random.Random(2)
    base = prose(rng, 200).split()
    near = [*base[:100], "other", *base[101:]]
    texts = [prose(rng, 80), " ".join(near), " ".join(base), prose(rng, 3), "", None, ""]
    docs = spark.createDataFrame(rows_of(texts, [5, 9, 2, 3, 4, 6, 4]), SCHEMA)
    out = STEPS["n-gram Jaccard join"](spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 4, 5, 6]


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    loads: dict = {}
    for r in rows:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert rows and max(loads.values()) <= 2048
    assert len(loads) <= -(-sum(loads.values()) // 2048) + 1


def test_empty_table_passes_through(spark, no_documents):
    docs = no_documents
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "")
    assert docs.count() == 0


def test_columns_with_odd_names_pass_through(spark, awkward):
    docs = awkward.withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2)).withColumn("row", F.lit(3))
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = step(spark, docs, "")
        assert docs.columns[-3:] == ["a.b", "c`d", "row"], name
    assert {(r[-3], r[-2], r[-1]) for r in docs.collect()} == {(1, 2, 3)}


def test_packing_in_the_pipeline_remembers_few_segments(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda docs, tokenizer, **given: asked.append(given) or docs)
    corpus_pipeline.packed(spark, None, "")
    assert asked[0]["memo_entries"] < tokenizing.MEMO_ENTRIES // 4


def test_line_stage_cuts_a_text_once(spark, awkward):
    out = STEPS["line dedup"](spark, awkward, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
