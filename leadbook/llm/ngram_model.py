"""LM scoring with a weighted backoff automaton over the whole corpus.

Documents are packed into chunks of bounded size.  A chunk asks for the corpus
counts of its own words, then of its own word pairs: it sends each distinct one,
with its training count in the chunk, to the part of the key space that owns it,
and the part answers every chunk with the sum.  With the answers a chunk holds the
piece of the automaton that its documents can reach, and walks it once per
document.  Nothing is sampled, pruned or capped, and no table goes to every task.

The model interpolates word pairs with single words (Jelinek-Mercer).  A context's
backoff mass is the Good-Turing share of pairs seen once among the pairs whose
first word is as frequent, in powers of two; the single-word model gives unseen
words the share of words seen once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook.llm.key_blocks import by_part, pack, pack_keys, unpack, unpack_keys
from leadbook.llm.language import crc_of_id
from leadbook.runtime import stage

# Characters of text in a chunk (a longer document is a chunk of its own), and distinct keys of a part.
CHUNK_CHARS = 8_000_000
PART_KEYS = 3_000_000
BUCKETS = 64

_END = np.uint64(0x454E44)  # keys of the end token and of the place before the first word
_START = np.uint64(0x535452)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_CHUNKS = "chunk long, n_tokens long, docs binary"
_ASKED = "part long, chunk long, keys binary, counts binary, buckets binary"
_ANSWERS = "kind int, part long, chunk long, totals binary"
WORD, PAIR, STATS = 0, 1, 2


def token_keys(text: str | None) -> np.ndarray:
    """Keys of the tokens of a text: words with A-Z lower-cased, then the end."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = _END
    return out


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    x = (before * _M1) ^ (after + (before >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


# --- chunks -----------------------------------------------------------------------


def _chunked(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            tokens = sum(t.as_py().count(" ") + 1 if t.as_py() else 1 for t in table.column(2))
            return pa.RecordBatch.from_pydict({"chunk": [base + number], "n_tokens": [tokens], "docs": [sink.getvalue().to_pybytes()]})

        size = 0
        for batch in batches:
            lengths = [len(t.as_py() or "") for t in batch.column(2)]
            first = 0
            for i, n in enumerate(lengths):
                size += n
                if size >= CHUNK_CHARS:
                    held.append(batch.slice(first, i + 1 - first))
                    yield flush()
                    held, size, first, number = [], 0, i + 1, number + 1
            if first < len(lengths):
                held.append(batch.slice(first))
        if held:
            yield flush()

    return docs.mapInArrow(run, _CHUNKS)


class Chunk:
    """Documents of a chunk as token keys, their distinct words, and where each document starts."""

    def __init__(self, data: bytes):
        table = pa.ipc.open_stream(data).read_all()
        self.doc_ids, self.held = table.column(0), np.array(table.column(1).to_pylist(), bool)
        keys = [token_keys(t.as_py()) for t in table.column(2)]
        lengths = np.array([len(k) for k in keys])
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.lengths = lengths
        self.tokens = np.concatenate(keys)
        self.trained = np.repeat(~self.held, lengths)
        self.words, self.at = np.unique(self.tokens, return_inverse=True)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.at[self.trained], minlength=len(self.words))

    def contexts(self) -> np.ndarray:
        """Index of the word before each token; the end token stands for the place before the first."""
        before = np.concatenate([[0], self.at[:-1]])
        before[self.starts] = np.searchsorted(self.words, _END)
        return before

    def pairs(self, counts: np.ndarray):
        """Per token: 0 where its pair has a word unseen in training and is so itself, else -1; the pair's key; its context."""
        before = self.contexts()
        known = np.where(np.minimum(counts[before], counts[self.at]) == 0, 0, -1)
        first = self.words[before].copy()
        first[self.starts] = _START
        return known, pair_keys(first, self.tokens), before


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """Frequency class of a context: the number of binary digits of its count."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], BUCKETS - 1).astype(np.uint8)


def _asked(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray | None, parts: int) -> list[tuple]:
    out = []
    for part, ix in by_part(keys, parts):
        classes = pack(buckets[ix]) if buckets is not None else b""
        out.append((part, chunk, pack_keys(keys[ix]), pack(counts[ix].astype("<u4")), classes))
    return out


def _ask_words(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, data in zip(batch["chunk"], batch["docs"]):
                own = Chunk(data)
                yield pd.DataFrame(_asked(chunk, own.words, own.word_counts(), None, parts), columns=["part", "chunk", "keys", "counts", "buckets"])

    return run


def _totals(chunk: int, kind: int, keys: np.ndarray, answers: pd.DataFrame, parts: int) -> np.ndarray:
    """The answered totals in the order of `keys`."""
    own = answers[answers["kind"] == kind].set_index("part")["totals"]
    out = np.zeros(len(keys), np.int64)
    for part, ix in by_part(keys, parts):
        out[ix] = unpack(own[part], "<u4")
    return out


def _ask_pairs(parts: int):
    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk, data in zip(chunks["chunk"], chunks["docs"]):
            own = Chunk(data)
            counts = _totals(chunk, WORD, own.words, answers, parts)
            known, keys, before = own.pairs(counts)
            classes = bucket_of(counts)[before]
            sent, first, at = np.unique(keys[known < 0], return_index=True, return_inverse=True)
            used = np.bincount(at[own.trained[known < 0]], minlength=len(sent))
            rows += _asked(chunk, sent, used, classes[known < 0][first], parts)
        return pd.DataFrame(rows, columns=["part", "chunk", "keys", "counts", "buckets"])

    return run


def _answer(kind: int):
    """Sum the counts of a part's keys over the chunks; answer each chunk; report the part's statistics."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        keys = [unpack_keys(k) for k in group["keys"]]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(c, "<u4") for c in group["counts"]])
        totals = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        if kind == WORD:
            stats = np.array([totals.sum(), (totals > 0).sum(), (totals == 1).sum()])
        else:
            classes = np.zeros(len(distinct), np.uint8)
            classes[at] = np.concatenate([unpack(b, "u1") for b in group["buckets"]])
            uses = np.bincount(classes, weights=totals, minlength=BUCKETS)
            once = np.bincount(classes[totals == 1], minlength=BUCKETS)
            stats = np.stack([uses, once])
        rows = [(kind, part, chunk, pack(totals[ix].astype("<u4"))) for chunk, ix in zip(group["chunk"], np.split(at, cuts))]
        rows.append((STATS, part, -1, stats.astype("<u8").tobytes()))
        return pd.DataFrame(rows, columns=["kind", "part", "chunk", "totals"])

    return run


# --- the automaton ------------------------------------------------------------------


class BackoffAutomaton:
    """States are histories of one word and the root; labels are words.

    A state has weighted arcs for the pairs seen in training and a failure arc to the root,
    whose arcs cover every label.  Reading a label leads to the state of that word, so a
    walk carries the last label and adds the weights it meets.
    """

    def __init__(self, root: np.ndarray, failure: np.ndarray, state: np.ndarray, label: np.ndarray, weight: np.ndarray):
        self.root, self.failure = root, failure
        arcs = state.astype(np.int64) * len(root) + label
        order = np.argsort(arcs)
        self.arcs, self.weights = arcs[order], weight[order]

    def walk(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The weight of each step: of the arc, or of the failure arc and the root's arc behind it."""
        steps = self.failure[states] + self.root[labels]
        if len(self.arcs):
            wanted = states.astype(np.int64) * len(self.root) + labels
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            hit = self.arcs[at] == wanted
            steps[hit] = self.weights[at[hit]]
        return steps


def single_word(counts: np.ndarray, total: int, once: int) -> np.ndarray:
    """P(word); words unseen in training share one event with the Good-Turing mass."""
    if not total:
        return np.ones(len(counts))
    unseen = min(max(once, 1) / (total + 1), 0.5)
    return np.where(counts > 0, (1 - unseen) * counts / total, unseen)


def pair_shares(uses: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Weight of the pair model per frequency class of the context: 1 less the share of pairs seen once."""
    return np.where(uses > 0, np.clip(1 - once / np.maximum(uses, 1), 0.005, 0.995), 0.0)


def _score(parts: int, totals: tuple[int, int, int], shares: np.ndarray):
    total, distinct, once = totals

    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, data in zip(chunks["chunk"], chunks["docs"]):
            own = Chunk(data)
            counts = _totals(chunk, WORD, own.words, answers, parts)
            pair_count, keys, before = own.pairs(counts)
            sent, at = np.unique(keys[pair_count < 0], return_inverse=True)
            pair_count[pair_count < 0] = _totals(chunk, PAIR, sent, answers, parts)[at]
            single = single_word(counts, total, once)
            share = np.where(counts > 0, shares[bucket_of(counts)], 0.0)
            # the state before the first word has the count of the end token: one per training text
            seen = np.flatnonzero(pair_count > 0)
            state = before.copy()
            state[own.starts] = len(own.words)
            arcs, pick = np.unique(state[seen].astype(np.int64) * len(own.words) + own.at[seen], return_index=True)
            seen = seen[pick]
            s, w = share[before[seen]], own.at[seen]
            weight = np.log10(s * pair_count[seen] / counts[before[seen]] + (1 - s) * single[w])
            start = np.searchsorted(own.words, _END)
            failure = np.log10(1 - np.concatenate([share, share[start : start + 1]]))
            automaton = BackoffAutomaton(np.log10(single), failure, state[seen], w, weight)
            steps = automaton.walk(state, own.at)
            base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))[own.at]
            sums = [np.add.reduceat(x, own.starts) for x in ((counts[own.at] > 0).astype(np.int64), base, steps)]
            out.append(pd.DataFrame({
                "doc_id": own.doc_ids.to_pandas().astype("Int64"), "held_out": own.held, "n_tokens": own.lengths, "n_known": sums[0],
                "train_tokens": total, "base_score": sums[1], "score": sums[2],
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 10 == 0


def score_documents(docs: DataFrame) -> DataFrame:
    """log10 probability of every whole text of `docs` (doc_id, text) under a model of the others.

    Training takes the documents whose crc32(doc_id as text) mod 10 is not 0; a null doc_id
    counts as empty text, whose remainder is 0.  A null text is empty: the end token alone.
    Without training tokens every token has probability 1.  Repeated rows count and are
    scored each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    chunks = stage(_chunked(rows), "chunks")
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(8, -(-tokens // PART_KEYS))
    words = stage(chunks.select("chunk", "docs").mapInPandas(_ask_words(parts), _ASKED).groupBy("part").applyInPandas(_answer(WORD), _ANSWERS), "word-counts")
    stats = [np.frombuffer(r["totals"], "<u8") for r in words.where(F.col("kind") == STATS).select("totals").collect()]  # one short row a part
    totals = tuple(int(x) for x in sum(stats)) if stats else (0, 0, 0)
    texts = chunks.select("chunk", "docs").groupBy("chunk")
    word_answers = words.where(F.col("kind") == WORD)
    asked = texts.cogroup(word_answers.groupBy("chunk")).applyInPandas(_ask_pairs(parts), _ASKED)
    pairs = stage(asked.groupBy("part").applyInPandas(_answer(PAIR), _ANSWERS), "pair-counts")
    found = [np.frombuffer(r["totals"], "<u8").reshape(2, -1) for r in pairs.where(F.col("kind") == STATS).select("totals").collect()]
    shares = pair_shares(*sum(found).astype(np.float64)) if found else np.zeros(BUCKETS)
    answers = word_answers.unionByName(pairs.where(F.col("kind") == PAIR))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.cogroup(answers.groupBy("chunk")).applyInPandas(_score(parts, totals, shares), schema)
