"""SentencePiece, HTML extraction, LM scoring, language ID and embeddings against brute force or held-out truth."""

from __future__ import annotations

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadbook.llm import ngram_model, segments
from leadbook.llm.embeddings import fit_centroids, near_duplicates
from leadbook.llm.html_content import ContentModel, extract_pages, features, labels, train
from leadbook.llm.dom import parse
from leadbook.llm.language import SuffixAutomaton, predict_documents, training_texts, with_language
from leadbook.llm.ngram_model import BackoffAutomaton, score_documents
from leadbook.llm.sentencepiece_scan import border_states, combine, decode_documents, encode_documents, lattice, matrix_of
from tests.llm.conftest import SCHEMA, prose, rows_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# --- SentencePiece ------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=list("abcdetherion    .,é漢😀\n\t▁"), max_size=50), chunk=st.integers(1, 20))
def test_chunks_give_the_ids_of_the_whole_text(text, chunk):
    assert lattice(PIECES).encode(text, chunk) == lattice(PIECES).processor.encode(text)


@settings(max_examples=150, deadline=None)
@given(
    texts=st.lists(st.none() | st.text(alphabet=list("abthe    .É漢😀\n\t▁\x00\r\u0301ﬁ"), max_size=20), max_size=6),
    limit=st.sampled_from([1, 30, 1 << 20]),
    cuts=st.booleans(),
)
def test_many_texts_give_the_ids_and_texts_of_the_library(texts, limit, cuts):
    own, ids = lattice(PIECES), []
    library = own.processor
    assert own.cuts
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(segments.portions, "__defaults__", (limit,))
        patch.setattr(own, "cuts", cuts)
        for found, bounds in own.encode_many(texts):
            ids += [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
            back = own.decode_many(found, bounds).to_pylist()
            assert back == [library.decode(i) if i else "" for i in ids[len(ids) - len(back) :]]
    assert ids == [library.encode(t or "") for t in texts]


def test_texts_of_any_ids_are_those_of_the_library():
    own, rng = lattice(PIECES), np.random.default_rng(4)
    bounds = np.sort(rng.integers(0, 3000, 400))
    bounds[0], bounds[-1] = 0, 3000
    ids = rng.integers(0, own.processor.vocab_size(), 3000).astype(np.int32)  # bytes, controls and no blank at the start too
    expected = [own.processor.decode(ids[a:b].tolist()) if a < b else "" for a, b in zip(bounds, bounds[1:])]
    assert own.decode_many(ids, bounds).to_pylist() == expected


def test_the_library_gets_each_word_of_many_texts_once(monkeypatch):
    own, sent = lattice(PIECES), []
    library = own.processor

    class Counted:
        def encode(self, texts, num_threads):
            sent.extend(texts)
            return library.encode(texts, num_threads=num_threads)

    monkeypatch.setattr(own, "processor", Counted())
    sizes = [bounds[-1] for _, bounds in own.encode_many(["the same words and the same"] * 300)]
    assert sizes == [300 * len(library.encode("the same words and the same"))]
    assert sorted(sent) == ["and", "same", "the", "words"]


def test_matrices_combine_in_any_grouping():
    own, text = lattice(PIECES), "therefore the other weather gathered there"
    parts = [own.matrix(own.processor.normalize(text), a, min(a + 5, len(text) + 1)) for a in range(0, len(text) + 1, 5)]
    left = parts[0]
    for m in parts[1:]:
        left = combine(left, m)
    right = parts[-1]
    for m in reversed(parts[:-1]):
        right = combine(m, right)
    assert left == right == matrix_of(PIECES, text, 5)
    assert border_states([]) == [(0, "")]


def test_encoding_round_trip(spark, awkward, no_documents):
    docs = awkward.select(F.monotonically_increasing_id().alias("uid"), "text")
    expected = {r.uid: r.text or "" for r in docs.collect()}
    coded = encode_documents(docs, PIECES, chunk=1000)  # the long text is many chunks
    got = {r.uid: r for r in decode_documents(coded, PIECES).collect()}
    assert {u: r.text for u, r in got.items()} == expected
    assert {u: list(r.ids) for u, r in got.items()} == {u: lattice(PIECES).processor.encode(t) for u, t in expected.items()}
    assert encode_documents(no_documents.select(F.lit(1).cast("long").alias("uid"), "text"), PIECES).count() == 0


# --- HTML -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return train()


def test_marginals_equal_enumeration():
    page = parse("<body><div class=nav><a href=x>Home</a></div><article><p>Some text.</p></article></body>")
    own = ContentModel({"tag:article": 1.0, "tag:p": 0.4, "name:nav": -2.0, "own1": 0.3}, (0.5, -1.0, -0.5, 1.5))
    found, n = features(page), len(page.nodes)
    weight = lambda fs: sum(own.weights.get(f, 0.0) for f in fs)
    total, on = 0.0, np.zeros(n)
    for bits in range(2**n):
        y = [bits >> i & 1 for i in range(n)]
        score = sum(weight(found[i]) * y[i] for i in range(n))
        score += sum(own.pairs[2 * y[page.nodes[i].parent] + y[i]] for i in range(1, n))
        total += math.exp(score)
        on += math.exp(score) * np.array(y)
    assert own.marginals(page, found) == pytest.approx((on / total).tolist())


def test_left_out_labelled_pages(model):
    """Each labelled page judged by a model trained on the others."""
    from leadbook.llm.labelled_pages import PAGES

    right = words = 0
    for k, html in enumerate(PAGES):
        own = train(PAGES[:k] + PAGES[k + 1 :], rounds=100)
        page = parse(html)
        for p, y, node in zip(own.marginals(page, features(page)), labels(page), page.nodes):
            words += node.words
            right += node.words * ((p > 0.5) == bool(y))
    assert right / words > 0.85


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages.withColumn("text", F.lit("clash"))).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(re.sub(r"</?b>", "", b.replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        plain = "\n\n".join(b for b in blocks if b)
        import html

        assert got[r.page_id].text == html.unescape(plain) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_broken_and_empty_pages(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p"), (None, "u", "<article><p>A&amp;B  c\n d<p>e"), (5, "u", "<" * 2000), (5, "u", "</b></div>x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert sorted(r.text for r in got if r.page_id in (1, 2, 3)) == ["", "", ""]
    assert next(r for r in got if r.page_id is None).text == "A&B c d\n\ne"
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    nested = "<div>" * 3000 + "<article><p>deep text here.</p></article>"
    assert model.extract(nested) in ("", "deep text here.")


def test_article_in_a_page_of_boilerplate(model):
    html = (
        "<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        '<div class="cookie-banner"><p>We use cookies. Read our policy.</p></div><article><h1>Wind &lt; rain</h1>'
        "<p>The wind turned at noon, and the boats stayed in. Nobody was hurt.</p><p>More tomorrow.</p></article>"
        '<div class="comments"><div class="comment"><p>I saw it from the pier. It was loud.</p></div></div>'
        "<footer>&copy; 2024 Pier News. All rights reserved.</footer><script>x()</script></body></html>"
    )
    assert model.extract(html) == "Wind < rain\n\nThe wind turned at noon, and the boats stayed in. Nobody was hurt.\n\nMore tomorrow."


# --- LM scoring ---------------------------------------------------------------------


def brute_scores(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [(i, [*word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</>"]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    single, pairs = collections.Counter(), collections.Counter()
    for i, t in texts:
        if not held(i):
            single.update(t)
            pairs.update(zip(["<>", *t], t))
    total, distinct = sum(single.values()), len(single)
    once = sum(n == 1 for n in single.values())
    context = lambda w: single["</>" if w == "<>" else w]
    unseen = min(max(once, 1) / (total + 1), 0.5)
    p1 = lambda w: (1 - unseen) * single[w] / total if single[w] else unseen
    uses, one = collections.Counter(), collections.Counter()
    for (x, _), n in pairs.items():
        uses[math.frexp(context(x))[1]] += n
        one[math.frexp(context(x))[1]] += n == 1
    out = []
    for i, t in texts:
        score = 0.0
        for x, y in zip(["<>", *t], t):
            b = math.frexp(context(x))[1]
            s = min(max(1 - one[b] / uses[b], 0.005), 0.995) if context(x) else 0.0
            score += math.log10((s * pairs[x, y] / context(x) if s else 0) + (1 - s) * p1(y))
        base = sum(math.log10((single[y] + 0.1) / (total + 0.1 * (distinct + 1))) for y in t)
        out.append((i, held(i), len(t), sum(single[y] > 0 for y in t), total, base, score))
    return out


def as_rows(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def test_scores_equal_brute_force(spark, awkward, monkeypatch):
    monkeypatch.setattr(ngram_model, "PART_KEYS", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    expected = brute_scores([(r.doc_id, r.text) for r in docs.collect()])
    got = score_documents(docs.withColumn("chunk", F.lit(1)).withColumn("keys", F.lit("x")))
    assert as_rows(tuple(r) for r in got.collect()) == as_rows(expected)
    held = [r for r in expected if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_scores_without_training_or_rows(spark, no_documents):
    assert score_documents(no_documents).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_walk_takes_arcs_or_fails_to_the_root():
    own = BackoffAutomaton(np.array([-1.0, -2.0]), np.array([-0.5, 0.0, -0.1]), np.array([0]), np.array([1]), np.array([-0.3]))
    assert own.walk(np.array([0, 0, 2]), np.array([1, 0, 1])).tolist() == [-0.3, -1.5, -2.1]


# --- language -----------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(text=st.text("ab ", max_size=30), query=st.text("abc ", max_size=15))
def test_longest_matches_equal_brute_force(text, query):
    count = at = 0
    while at < len(query):
        n = max((n for n in range(1, len(query) - at + 1) if query[at : at + n] in text), default=1)
        at, count = at + n, count + 1
    assert SuffixAutomaton(text).phrases(query) == count


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark, awkward, no_documents):
    rows = predict_documents(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {0, 1, 2, 11}
    assert predict_documents(no_documents).count() == 0
    assert training_texts(awkward.withColumn("lang", F.lit(None).cast("string"))) == {}
    judged = with_language(awkward.drop("lang"), {}).collect()
    assert {r.lang_pred for r in judged} == {"und"} and len(judged) == awkward.count()


# --- embeddings -----------------------------------------------------------------------


def near_copies(seed, n, dim):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    copies = [b + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.3]) for b in base[: n // 3] for _ in range(rng.integers(1, 4))]
    return np.concatenate([base, copies]).astype(np.float32)


def links_of(vectors, threshold):
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(len(unit))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(unit)).min(1))
        if (new == label).all():
            return linked.sum(1), label
        label = new


def test_one_cell_equals_brute_force(spark):
    vectors = near_copies(1, 300, 16)
    counts, leads = links_of(vectors, 0.9)
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, node string")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert [got[k].n_links for k in range(len(vectors))] == counts.tolist()
    assert [got[k].component_id for k in range(len(vectors))] == leads.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_many_cells_and_blocks(spark, monkeypatch):
    from leadbook.llm import embeddings

    monkeypatch.setattr(embeddings, "CELL_ROWS", 100)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 32)
    vectors = near_copies(2, 600, 64)
    counts, _ = links_of(vectors, 0.9)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    assert all(got[k] <= counts[k] for k in got)
    assert sum(got.values()) >= 0.99 * counts.sum()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (8, [1.0, 0.0]), (9, [1.0]), (None, [1.0, 0.01]), (10, [3e38, 3e38])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None)
    expected = [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 6, 9, 10)] + [(7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False)]
    assert found == sorted(expected)
    assert next(r for r in got if r.vec_id is None).component_id == 7
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_centroids_are_unit_vectors():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(500, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    assert np.linalg.norm(fit_centroids(sample, 7), axis=1) == pytest.approx(np.ones(7))


def test_no_link_of_low_rank_vectors_is_missed(spark, monkeypatch):
    from leadbook.llm import embeddings

    monkeypatch.setattr(embeddings, "CELL_ROWS", 100)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(1500, 8)) @ rng.normal(size=(8, 384))).astype(np.float32)
    counts, leads = links_of(vectors, 0.9)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert [got[k].n_links for k in range(len(vectors))] == counts.tolist()
    assert [got[k].component_id for k in range(len(vectors))] == leads.tolist()


@pytest.mark.parametrize(
    "extra, shown",
    [
        ("<svg class='a/b' width='1'/>", ""),
        ("<svg><svg><path d='M0'/></svg><text>icon</text></svg>", ""),
        ("<svg><script>'</svg>'</script><text>icon</text></svg>", ""),
        ("<svg><path d='M0'>", ""),
        ("<math/>", ""),
        ("<math><mi>E</mi><mo>=</mo><mi>m</mi><mspace/><annotation>tex</annotation></math>", "E=m"),
        ("<noscript>", ""),
        ("<iframe src=x>", ""),
        ("<script>x()</script><style>p{}</style><template><template>t</template>u</template>", ""),
    ],
)
def test_no_raw_element_swallows_the_article(model, extra, shown):
    first, last = "The wind turned at noon, and the boats stayed in. Nobody was hurt", "More boats went out on the next day, and all came back."
    got = model.extract(f"<body>{extra}<article><p>{first} {extra}.</p><p>{last}</p></article></body>")
    assert "".join(got.split()) == "".join(f"{shown}{first}{shown}.{last}".split()) or "".join(got.split()) == "".join(f"{first}{shown}.{last}".split())


def test_object_fallback_is_judged(model):
    got = model.extract("<article><p>The wind turned at noon. Nobody was hurt.</p><object data=x><p>The film shows the boats. It was made at noon.</p></object></article>")
    assert "The film shows the boats." in got
    assert parse("<p>a<svg><svg>").pieces and model.extract("<svg>" * 20_000 + "x") in ("", "x")


def test_every_drawn_text_gives_its_share(spark):
    from leadbook.llm.language import LANGUAGE_CHARS, equal_share

    assert [equal_share(ns, 100) for ns in ([10, 500, 600], [30, 30], [], [200])] == [45, 30, 0, 100]
    opening = "same opening for all " * 100
    rows = [(k, opening + f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} " * 300, "en") for k in range(100)]
    rows += [(100 + k, "other words here " * 600, f"l{k}") for k in range(40)]
    texts = training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = {w for w in texts["en"].split() if len(w) == 6 and w.startswith("word")}
    assert len(own) > 50 and 50_000 < len(texts["en"]) <= LANGUAGE_CHARS
    assert all(len(texts[f"l{k}"]) > 9_000 for k in range(40))


@pytest.mark.parametrize(
    ("html", "shown"),
    [
        ('<article><p>Rain <img alt="foo"">stopped play.</p></article>', "Rain stopped play."),
        ("<article><p title=don't>Rain stopped play.</p></article>", "Rain stopped play."),
        ('<article><p class="x>Rain stopped play.</p></article>', "Rain stopped play."),
        ('<article><p title="a > b" class=x>Rain stopped play.</p></article>', "Rain stopped play."),
        ("<article><p data-a=x\"y'z>Rain stopped play.</p></ x></></article>", "Rain stopped play."),
        ("<article><!--><p>Rain < stopped play.</p></article>", "Rain < stopped play."),
    ],
)
def test_no_markup_in_the_text(model, html, shown):
    assert model.extract(html) == shown


@pytest.mark.parametrize(
    "html",
    ["<article><p>{}</p></article>", "<p>{}</p>", "{}", "<body><nav><a href=/>Home</a></nav><article><div class=more>{}</div></article></body>"],
)
def test_short_articles_are_kept(model, html):
    for text in ("Rain stopped play.", "The boats stayed in the harbour all day, and nobody knew why. It rained."):
        assert model.extract(html.format(text)) == text


def test_link_rich_paragraphs_are_kept(model):
    long = "The council met on Monday, and the road was closed. " * 6
    html = f"<article><p><a href=x>The first report of the council</a></p><p>{long}</p><p><a href=y>The second report</a></p></article>"
    assert model.extract(html) == f"The first report of the council\n\n{long.strip()}\n\nThe second report"


@pytest.mark.parametrize(
    "page",
    ["<a b='" * 160_000, '<a b="' * 160_000 + "<p>x", "<b>" * 60_000 + "<p>x</p>" * 60_000, "<head>" * 160_000 + "x", '<svg "' * 160_000, "<" * 1_000_000],
)
def test_hostile_pages_are_read_in_linear_time(page):
    small, large = page[: len(page) // 8], page
    began = time.perf_counter()
    parse(small)
    middle = time.perf_counter()
    parse(large)
    assert time.perf_counter() - middle < 24 * (middle - began) + 1
