"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

An encoding is the heaviest path through the lattice of pieces that match a text.  A
path's state at a chunk border is the place where the piece across it ends and, for
merge-based (BPE) models, that piece.  A chunk yields the max-plus matrix from the
states at its start to those at its end; matrices combine associatively, and once the
states at both borders are known each chunk traces its own part of the path.

Steps weigh the piece's score in unigram models.  In BPE models a step from piece t to u
weighs 0 if merging the text t + u gives exactly t, u, and is barred otherwise: a
sequence is the result of the merges if and only if all its neighbours are, so one path
of weight 0 is left.  Documents of one chunk go to the `sentencepiece` library; where
no piece joins a blank to what stands before it, a word has the same ids alone, and the
library gets each distinct one of some hundred texts once.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadbook.llm.segments import dealt, distinct, laid_out, portions
from leadbook.llm.worker_cache import held

CHUNK_CHARS = 65_536
# Pairs of pieces of one worker's memo, which is emptied when full.
MEMO_PAIRS = 500_000
UNKNOWN_PENALTY = 10.0

State = tuple[int, str]  # where the last piece ends, and that piece ("" where it has no influence)
Matrix = dict[State, dict[State, float]]


def combine(first: Matrix, second: Matrix) -> Matrix:
    """The max-plus product of the matrices of two neighbouring chunks."""
    out: Matrix = {}
    for start, row in first.items():
        sums: dict[State, float] = {}
        for mid, a in row.items():
            for end, b in second.get(mid, {}).items():
                if a + b > sums.get(end, -np.inf):
                    sums[end] = a + b
        out[start] = sums
    return out


class Lattice:
    """Steps through a normalised text under a model file."""

    def __init__(self, model: str):
        self.processor = sp = spm.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        # text of each id that stands for itself; the others need the library
        self.shown: list[str | None] = [None] * sp.vocab_size()
        for piece, i in self.ids.items():
            self.shown[i] = piece.replace("▁", " ")
        for byte, i in self.bytes.items():
            self.shown[i] = chr(byte) if byte < 128 else None
        self.joins = sp.normalize("a  b") == "▁a▁▁b"
        trainer, normalizer = _sections(model)
        self.merges = trainer.get(3, 1) == 2
        # Texts are taken as they are behind one more blank, and blanks stand in a piece only at its start.
        kept = not normalizer.get(2) and [normalizer.get(k, 1) for k in (3, 4, 5)] == [1, 0, 1] and not trainer.get(24)
        odd = {i for i in range(sp.vocab_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        shaped = all(re.fullmatch("▁*[^▁]*", sp.id_to_piece(i)) for i in range(sp.vocab_size()) if i not in odd)
        self.cuts = bool(self.joins and self.merges and self.bytes and "▁" in self.ids and kept and shaped)
        # the text of each id, then the same without the blank that a text's first piece begins with
        self.plain = np.array([t is not None for t in self.shown])
        self.opens = np.array([t is not None and t.startswith(" ") for t in self.shown])
        self.written = pa.array([t or "" for t in self.shown] + [(t or "")[1:] for t in self.shown], pa.large_string())
        self.strange = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """A short text by merges: best score first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max(((self.scores.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if score == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def fits(self, last: str, piece: str) -> bool:
        """Whether merges leave `piece` behind `last` ("" at the start of the text)."""
        key = (last, piece)
        if key not in self.memo:
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            self.memo[key] = self.merged(last + piece) == [p for p in key if p]
        return self.memo[key]

    def pieces(self, text: str, at: int) -> list[str]:
        """Pieces that match at a place; a character that is no piece stands for itself."""
        found = [p for n in range(1, min(self.longest, len(text) - at) + 1) if (p := text[at : at + n]) in self.ids]
        return found if text[at] in self.ids else [text[at], *found]

    def walk(self, text: str, start: State, end: int, like: list | None = None):
        """Best (weight, last piece, state before) per place from `start` up to the first places at or past `end`.

        `like` holds the places of another walk over the same text; where the two have run
        alike over a longest piece, up to a constant, the rest is taken from there.
        """
        best: list = [None] * (end + self.longest + 1)
        best[start[0]] = (0.0, start[1], None)
        alike, gap = 0, None
        for at in range(start[0], end):
            here = best[at]
            if like is not None:
                other = like[at]
                if here is None or other is None or here[1] != other[1]:
                    alike, gap = (alike + 1, gap) if here is None and other is None else (0, None)
                else:
                    apart = here[0] - other[0]
                    alike, gap = (alike + 1, gap) if gap is not None and abs(apart - gap) < 1e-9 else (1, apart)
                if alike > self.longest and gap is not None:
                    for k in range(at + 1, len(best)):
                        if like[k] is not None:
                            best[k] = (like[k][0] + gap, *like[k][1:])
                    return best
            if here is None:
                continue
            weight, last, _ = here
            for piece in self.pieces(text, at):
                if self.merges:
                    if not self.fits(last, piece):
                        continue
                    total, key = weight, piece
                else:
                    total, key = weight + self.scores.get(piece, self.strange), ""
                to = best[at + len(piece)]
                if to is None or total > to[0]:
                    best[at + len(piece)] = (total, key, at)
        return best

    def entries(self, text: str, at: int) -> list[State]:
        """The states that a path can have at a border: pieces that end there or cross it."""
        if not at:
            return [(0, "")]
        found = set()
        for begin in range(max(0, at - self.longest), at):
            for piece in self.pieces(text, begin):
                if begin + len(piece) >= at:
                    found.add((begin + len(piece), piece if self.merges else ""))
        return sorted(found)

    def matrix(self, text: str, begin: int, end: int) -> Matrix:
        """The max-plus matrix of a chunk [begin, end) of `text`, which reaches a longest piece beyond both borders."""
        out, like = {}, None
        for start in self.entries(text, begin):
            if start[0] >= end and end < len(text):
                out[start] = {start: 0.0}
                continue
            best = self.walk(text, start, end, like)
            like = like or best
            out[start] = {(k, b[1]): b[0] for k in range(end, len(best)) if (b := best[k]) is not None}
        return out

    def trace(self, text: str, start: State, stop: State, end: int) -> list[int]:
        """ids of the path between two states of a chunk."""
        if start == stop:
            return []
        best, at, out = self.walk(text, start, end), stop[0], []
        while at > start[0]:
            before = best[at][2]
            out.append(text[before:at])
            at = before
        return [i for p in reversed(out) for i in self.ids_of(p)]

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [self.processor.unk_id()]

    def encode(self, text: str, chunk: int = CHUNK_CHARS) -> list[int]:
        """A whole text by the scan, in one process; the job does the same with a task per chunk."""
        whole = self.processor.normalize(text)
        parts = spans(len(whole), chunk)
        matrices = [self.matrix(whole, a, b) for a, b in parts]
        states = border_states(matrices)
        ids = [self.trace(whole, s, t, b) for (_, b), s, t in zip(parts, states, states[1:])]
        return self.joined(ids)

    def encode_many(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The library's ids of whole texts, a few at a time in order: those of all, and where each text's begin and the last one's end."""
        for own in portions(texts):
            # A text that holds the sign of a blank is one segment, and so the only kind that holds one.
            data, bounds = laid_out([(" " + t if t and self.cuts and "▁" not in t else t).encode() for t in own])
            if not len(data):
                yield np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
                continue
            begin = np.zeros(len(data), bool)
            if self.cuts:
                begin[1:] = (data[1:] == 32) & (data[:-1] != 32)
                for k in (k for k, t in enumerate(own) if "▁" in t):
                    begin[bounds[k] : bounds[k + 1]] = False
            begin[bounds[:-1][np.diff(bounds) > 0]] = True
            begins = np.flatnonzero(begin)
            numbers, parts = distinct(data, begins)
            ids = self.processor.encode([p[1:] if self.cuts and "▁" not in p else p for p in parts], num_threads=1)
            for k in (k for k, p in enumerate(parts) if self.cuts and p == " "):
                ids[k] = [self.ids["▁"]]  # a blank that ends a text; alone it would be none
            values = pa.array(ids, pa.large_list(pa.int32()))
            found, ends = dealt(numbers, values.values.to_numpy(), values.offsets.to_numpy())
            yield found, ends[np.searchsorted(begins, bounds)]

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The library's texts of the ids between `bounds`; ids that stand for themselves are joined without it."""
        first = bounds[:-1][np.diff(bounds) > 0]
        shown = ids.astype(np.int64)
        shown[first] += len(self.shown)
        strange = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(~self.plain[ids], out=strange[1:])
        joined = (strange[bounds[1:]] == strange[bounds[:-1]]) & self.joins
        filled = np.flatnonzero(np.diff(bounds) > 0)
        joined[filled] &= self.opens[ids[first]]
        laid = self.written.take(pa.array(shown))
        offsets = np.frombuffer(laid.buffers()[1], np.int64)[bounds]
        texts = pa.LargeStringArray.from_buffers(len(joined), pa.py_buffer(offsets), laid.buffers()[2])
        others = [self.processor.decode(ids[bounds[k] : bounds[k + 1]].tolist()) if bounds[k] < bounds[k + 1] else "" for k in np.flatnonzero(~joined)]
        return pc.replace_with_mask(texts, pa.array(~joined), pa.array(others, pa.large_string())).cast(pa.string())

    def joined(self, chunks: list[list[int]]) -> list[int]:
        """Chunks' ids in order; without byte pieces a run of unknown characters is one id."""
        ids = [i for part in chunks for i in part]
        if self.bytes:
            return ids
        unknown = self.processor.unk_id()
        return [i for k, i in enumerate(ids) if i != unknown or not k or ids[k - 1] != unknown]


def _sections(model: str) -> list[dict]:
    """The numbered fields of a model file's trainer section (field 2) and normalizer section (field 3)."""
    with open(model, "rb") as f:
        data = f.read()

    def fields(buffer: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = buffer[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(buffer):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            elif key & 7 == 2:
                size = number()
                yield key >> 3, buffer[at : at + size]
                at += size
            else:
                at += 8 if key & 7 == 1 else 4
                yield key >> 3, None

    own = {k: v for k, v in fields(data) if k in (2, 3)}
    return [dict(fields(own.get(k, b""))) for k in (2, 3)]


def spans(length: int, chunk: int) -> list[tuple[int, int]]:
    return [(a, min(length, a + chunk)) for a in range(0, length, chunk)]


def border_states(matrices: list[Matrix]) -> list[State]:
    """The state of the heaviest path at every border, the text's start and end included."""
    if not matrices:
        return [(0, "")]
    suffixes = [matrices[-1]]
    for m in reversed(matrices[:-1]):
        suffixes.append(combine(m, suffixes[-1]))
    suffixes.reverse()
    states = [(0, "")]
    for m, rest in zip(matrices, [*suffixes[1:], None]):
        row = m[states[-1]]
        ahead = {s: w + (max(rest[s].values(), default=-np.inf) if rest else 0.0) for s, w in row.items() if rest is None or s in rest}
        states.append(max(sorted(ahead), key=ahead.get))
    return states


def _shift(matrix: Matrix, by: int) -> Matrix:
    return {(a + by, p): {(b + by, q): w for (b, q), w in row.items()} for (a, p), row in matrix.items()}


def lattice(model: str) -> Lattice:
    return held(("lattice", model), lambda: Lattice(model))


_PARTS = "uid long, k int, first long, begin int, end int, text string"


def encode_documents(docs: DataFrame, model: str, chunk: int = CHUNK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """`uid, *carry, ids` for the rows of `docs` (uid, text): the ids that the library gives for the whole text.

    A null or empty text has no ids.  A document of more than `chunk` normalised
    characters is split; its chunks are tasks' rows of bounded size throughout.
    uid must be unique; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("uid", *carry, F.col("text").cast("string").alias("text"))
    giant = F.coalesce(F.char_length("text") >= chunk, F.lit(False))  # the blank put before a text counts

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            last = batch.num_columns - 1
            for part in _slices(batch):
                at = 0
                for ids, bounds in own.encode_many(part.column(last).to_pylist()):
                    own_rows = part.select(range(last)).slice(at, len(bounds) - 1)
                    at += len(bounds) - 1
                    yield _with_column(own_rows, "ids", pa.ListArray.from_arrays(bounds.astype(np.int32), ids))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lattice(model)
        for batch in batches:
            for uid, text in zip(batch["uid"], batch["text"]):
                text = own.processor.normalize(text)
                out = []
                for k, (a, b) in enumerate(spans(len(text), chunk)):
                    low, high = max(0, a - own.longest), min(len(text), b + own.longest)
                    out.append((uid, k, low, a - low, b - low, text[low:high]))
                yield pd.DataFrame(out, columns=["uid", "k", "first", "begin", "end", "text"])

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lattice(model)
        for batch in batches:
            found = [
                pickle.dumps(_shift(own.matrix(t, b, e), f)) for t, b, e, f in zip(batch["text"], batch["begin"], batch["end"], batch["first"])
            ]
            yield batch[["uid", "k"]].assign(matrix=found)

    def borders(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        states = border_states([pickle.loads(m) for m in group["matrix"]])
        return group[["uid", "k"]].assign(
            start=[s[0] for s in states[:-1]], start_piece=[s[1] for s in states[:-1]],
            stop=[s[0] for s in states[1:]], stop_piece=[s[1] for s in states[1:]],
        )

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lattice(model)
        for batch in batches:
            ids = [
                own.trace(r.text, (r.start - r.first, r.start_piece), (r.stop - r.first, r.stop_piece), r.end) for r in batch.itertuples()
            ]
            yield batch[["uid", "k"]].assign(ids=ids)

    kept = rows.select("uid", *carry).schema
    small = rows.where(~giant).mapInArrow(whole, T.StructType([*kept.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    chunks = rows.where(giant).select("uid", "text").mapInPandas(split, _PARTS)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(tasks, "uid", "k")  # the chunks of one document go to many tasks
    matrices = chunks.mapInPandas(transfer, "uid long, k int, matrix binary")
    states = matrices.groupBy("uid").applyInPandas(borders, "uid long, k int, start long, start_piece string, stop long, stop_piece string")
    traced = chunks.join(states, ["uid", "k"]).mapInPandas(trace, "uid long, k int, ids array<int>")
    parts = traced.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))

    @F.pandas_udf("array<int>")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ids: lattice(model).joined([np.asarray(p).tolist() for p in ids]))

    large = parts.select("uid", joined(F.col("parts.ids")).alias("ids"))
    named = rows.where(giant).select("uid", *carry).join(large, "uid")
    return small.unionByName(named)


def decode_documents(ids: DataFrame, model: str) -> DataFrame:
    """The rows of `ids` with `text`: the library's text of column `ids`; null or no ids give an empty text.

    Byte pieces that are no valid UTF-8 become U+FFFD, as in the library.
    """

    place = ids.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            for part in _slices(batch):
                ids = part.column(place)
                bounds = np.zeros(part.num_rows + 1, np.int64)
                np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False), out=bounds[1:])
                yield _with_column(part, "text", own.decode_many(ids.flatten().to_numpy(), bounds))

    return ids.mapInArrow(run, T.StructType([*ids.schema.fields, T.StructField("text", T.StringType())]))


def _slices(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, since the work on them takes several times their text, in every worker."""
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def matrix_of(model: str, text: str, chunk: int) -> Matrix:
    """The whole text's matrix, by combining those of its chunks in any grouping."""
    own = lattice(model)
    whole = own.processor.normalize(text)
    return reduce(combine, (own.matrix(whole, a, b) for a, b in spans(len(whole), chunk)))
