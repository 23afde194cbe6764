"""Token ids, token files and packing against the library and brute force."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st

from leadbook.llm.elias_fano import EliasFano
from leadbook.llm.packing import best_fit, cross, evolve, fitness, pack_documents, pack_items, seeds
from leadbook.llm import packing, segments, tokenizing
from leadbook.llm.token_files import TokenFile, read_token_files, write_token_files
from leadbook.llm.tokenizing import Encoder

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENCODERS = {p: Encoder(p) for p in (BYTES, WORDS)}
PARTS = [*"ab'sEÉé ,.\n\t_-9ªµ|¿×ÿǅŉ²½\xa0\x1c\r漢İ", "'s", "'ll", " \n", "<|endoftext|>"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


def plain(path: str, text: str | None) -> list[int]:
    return ENCODERS[path].tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_segments_give_the_ids_of_the_whole_text(path, text):
    ids = plain(path, text)
    assert ENCODERS[path].encode(text) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.none() | TEXTS, max_size=8), end=st.none() | st.just(7), limit=st.sampled_from([1, 40, 1 << 20]))
def test_many_texts_give_the_ids_of_each(path, texts, end, limit):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(segments.portions, "__defaults__", (limit,))
        got = [ids[a:b].tolist() for ids, bounds in ENCODERS[path].encode_many(texts, end) for a, b in zip(bounds, bounds[1:])]
    assert got == [plain(path, t) + ([] if end is None else [end]) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_letters_whose_small_form_is_not_in_the_proven_range(path):
    for letter in "ƁƆƉƊƎƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɁɃɄɅİ":
        ids = plain(path, text := f"x{letter}y {letter} a{letter}")
        assert Encoder(path).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_the_memo_is_asked_once_for_a_segment_of_many_texts():
    class Counted(dict):
        asked: list[str] = []

        def __getitem__(self, segment):
            self.asked.append(segment)
            return memo[segment]

    own = Encoder(BYTES)
    memo, own.memo = own.memo, Counted()
    sizes = [b[-1] for _, b in own.encode_many(["common words, common words"] * 500)]
    assert sizes == [500 * len(plain(BYTES, "common words, common words"))]
    assert sorted(Counted.asked) == [" common", " words", ",", "common"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_are_coded_as_the_library_codes_them(path):
    library = Tokenizer.from_file(path)
    for text in ("a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|startoftext|> y", "<|ENDOFTEXT|>", "a < |endoftext|> b"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert Encoder(path).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_a_full_memo_keeps_what_is_asked_for(monkeypatch):
    monkeypatch.setattr(tokenizing, "MEMO_ENTRIES", 20)
    own, coded = Encoder(BYTES), []
    monkeypatch.setattr(own.memo, "_coded", lambda segment: coded.append(segment) or type(own.memo)._coded(own.memo, segment))
    for k in range(300):
        text = f"common word{chr(97 + k % 26)}{chr(97 + k // 26)} common"
        assert own.encode(text) == struct.pack(f"<{len(plain(BYTES, text))}I", *plain(BYTES, text))
    assert coded.count(" common") == 1 and len(own.memo) <= 20 and len(own.memo.older) <= 20
    own.encode("y" * 100)
    assert "y" * 100 not in own.memo


def test_an_encoder_of_a_small_memo_gives_the_same_ids():
    own = Encoder(BYTES, memo_entries=20)
    for k in range(300):
        text = f"common word{chr(97 + k % 26)}{chr(97 + k // 26)} common"
        assert own.encode(text) == ENCODERS[BYTES].encode(text)
        assert len(own.memo) <= 20 and len(own.memo.older) <= 20


def test_starts_behind_a_text_with_an_added_token(spark):
    docs = [(0, "a <|endoftext|> b"), (1, "<|startoftext|> c"), (2, "d e")]
    got = read_token_files(write_token_files(spark.createDataFrame(docs, "doc_id long, text string"), WORDS, 2)).orderBy("doc_id").collect()
    sizes = [len(Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids) + 1 for _, t in docs]
    assert [r.n_tokens for r in got] == sizes and [r.start for r in got] == [0, sizes[0], sizes[0] + sizes[1]]


@settings(max_examples=100, deadline=None)
@given(values=st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 500), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert code.values().tolist() == values
    assert [code.value(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000)).astype(np.uint64)
    assert len(EliasFano.of(values).to_bytes()) < 20_000 * 13.5 / 8


def test_elias_fano_refuses_a_decrease():
    with pytest.raises(ValueError, match="must not decrease"):
        EliasFano.of(np.array([3, 2], np.uint64))


def test_token_files_equal_brute_force(awkward):
    got = read_token_files(write_token_files(awkward, WORDS, 2)).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    sizes = {}
    for doc_id, text in rows:
        ids = [*plain(WORDS, text), 2]
        sizes.setdefault(doc_id, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for doc_id, own in sizes.items():
        assert sorted(own) == sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == doc_id)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_token_file_gives_any_document(spark):
    docs = spark.createDataFrame([(k, f"word {k} " * (k % 5)) for k in range(40)], "doc_id long, text string")
    shards = [TokenFile(r.path) for r in write_token_files(docs, WORDS, 2).collect()]
    found = {d: f.ids(i, i + 1).tolist() for f in shards for i, d in enumerate(f.documents())}
    assert found == {k: [*plain(WORDS, f"word {k} " * (k % 5)), 2] for k in range(40)}


def test_token_files_of_nothing(no_documents):
    assert read_token_files(write_token_files(no_documents, WORDS, 2)).count() == 0


def packed_well(rows, texts):
    """Every document's pieces are whole, and sequences are gapless and not too long."""
    for doc_id, text in texts:
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = [*plain(BYTES, text), 0]
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // 2048) and all(r.length == 2048 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        ends = [0, *np.cumsum([n for _, n in parts])]
        assert [o for o, _ in parts] == ends[:-1] and ends[-1] <= 2048
    return len(by)


def test_packing_equals_brute_force(awkward):
    docs = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    packed_well(pack_documents(docs, BYTES, 0).collect(), texts)
    assert pack_documents(awkward, BYTES, 0).count() >= awkward.count()


def test_packing_meets_the_bound(spark):
    sizes = np.random.default_rng(2).integers(1, 1500, 3000).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, size long")
    rows = pack_items(items, 2048, shard_items=512).collect()  # several shards and levels
    assert sorted(r.uid for r in rows) == list(range(3000))
    loads: dict = {}
    for r in rows:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + sizes[r.uid]
    assert max(loads.values()) <= 2048
    assert len(loads) <= -(-sum(sizes) // 2048) + 4


def test_packing_of_nothing(no_documents):
    assert pack_documents(no_documents, BYTES, 0).count() == 0


def test_evolution_beats_its_seed():
    rng = np.random.default_rng(0)
    sizes = []  # triples that fill a bin exactly, which best-fit decreasing does not find
    for _ in range(40):
        a, b = rng.integers(260, 400, 2).tolist()
        sizes += [a, b, 1000 - a - b]
    first = best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000)
    best = evolve(seeds(sizes, 1000, 6, rng), sizes, 1000, 60, rng)[0]
    assert sorted(i for b in best for i in b) == list(range(len(sizes)))
    assert fitness(best, sizes, 1000) < fitness(first, sizes, 1000)


def test_a_grouping_is_rated_once(monkeypatch):
    rng, rated = np.random.default_rng(0), []
    sizes = [334] * 60  # two fit into a sequence, so the bound of the sizes is never met
    first = seeds(sizes, 1000, 6, rng)
    monkeypatch.setattr(packing, "fitness", lambda *a: rated.append(1) or fitness(*a))
    evolve(first, sizes, 1000, 5, rng)
    assert len(rated) == len(first) + 5 * 3


def test_crossover_keeps_every_document_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 900, 200).tolist()
    a, b = (best_fit(rng.permutation(200).tolist(), sizes, 1000) for _ in range(2))
    child = cross(a, b, sizes, 1000, rng)
    assert sorted(i for g in child for i in g) == list(range(200))
    assert max(sum(sizes[i] for i in g) for g in child) <= 1000
