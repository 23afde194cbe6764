"""Language ID by cross-parsing entropy: the language whose text covers a document in the fewest phrases."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadbook.llm.worker_cache import held

UNKNOWN = "und"
# The sample that fits the automata: at most so many distinct labelled texts of a language,
# and so many characters of them, however many languages there are.
SAMPLE_TEXTS = 200
LANGUAGE_CHARS = 60_000
# Words of one worker's memo, which is emptied when full, and the longest word it keeps.
MEMO_WORDS = 250_000
MEMO_WORD_CHARS = 64

_WORDS = regex.compile(r"(?:\p{L}\p{M}*)+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class SuffixAutomaton:
    """The minimal automaton of all substrings of a text.

    Most states have one way on; only the others keep a table.
    """

    def __init__(self, text: str):
        states = self._states(text)
        self.only = [next(iter(d)) if len(d) == 1 else None for d in states]
        self.ahead = array("q", [next(iter(d.values())) if len(d) == 1 else 0 for d in states])
        self.ways = [d if len(d) != 1 else None for d in states]

    @staticmethod
    def _states(text: str) -> list[dict[str, int]]:
        out: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            state = len(out)
            out.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in out[p]:
                out[p][ch] = state
                p = link[p]
            if p >= 0:
                q = out[p][ch]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    clone = len(out)
                    out.append(dict(out[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[state] = clone
                    while p >= 0 and out[p].get(ch) == q:
                        out[p][ch] = clone
                        p = link[p]
            last = state
        return out

    def phrases(self, text: str) -> int:
        """Phrases of the parse in which each is the longest match from its start; a strange character is one."""
        count, at, end = 0, 0, len(text)
        only, ahead, ways = self.only, self.ahead, self.ways
        while at < end:
            state, start = 0, at
            while at < end:
                ch = text[at]
                if only[state] == ch:
                    state = ahead[state]
                elif (table := ways[state]) and ch in table:
                    state = table[ch]
                else:
                    break
                at += 1
            at += at == start
            count += 1
        return count


class CrossParser:
    """Phrases of words against the text of each language; a parse starts anew at every word.

    A word is parsed with a blank on either side, so that a match can hold its start or end.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.automata = [SuffixAutomaton(texts[k]) for k in self.languages]
        # a phrase costs the bits that point into the language's text
        self.bits = np.array([math.log2(max(2, len(texts[k]))) for k in self.languages])
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.counts = np.zeros((1024, len(self.languages)), np.int64)

    def _row(self, word: str) -> int:
        row = self.rows.get(word)
        if row is None:
            row = self.rows[word] = len(self.rows)
            if row == len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.counts[row] = [a.phrases(f" {word} ") for a in self.automata]
        return row

    def entropy(self, text: str | None) -> np.ndarray | None:
        """Bits per character under each language; None without letters."""
        words = words_of(text)
        if not words:
            return None
        if len(self.rows) > MEMO_WORDS:
            self._forget()
        total, chars = np.zeros(len(self.languages), np.int64), 0
        for word in [w for w in words if len(w) > MEMO_WORD_CHARS]:
            total += [a.phrases(f" {word} ") for a in self.automata]
        kept = [self._row(w) for w in words if len(w) <= MEMO_WORD_CHARS]
        if kept:
            total += self.counts[kept].sum(0)
        chars = sum(map(len, words)) + 2 * len(words)
        return total * self.bits / chars

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the lowest entropy (by name on a tie), and 1 less its share of the next one's."""
        bits = self.entropy(text)
        if bits is None or not self.languages:
            return UNKNOWN, 0.0
        order = np.argsort(bits, kind="stable")
        score = 1.0 if len(order) == 1 else 1.0 - bits[order[0]] / bits[order[1]]
        return self.languages[order[0]], float(score)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def equal_share(lengths: list[int], room: int) -> int:
    """The most characters that each text may give so that all together fit: short ones give all, others the same."""
    for k, n in enumerate(sorted(lengths)):
        share = room // (len(lengths) - k)
        if n > share:
            return share
        room -= n
    return max(lengths, default=0)


def _whole_words(piece: str, at_start: bool, at_end: bool) -> str:
    """A piece of a text without the words that its ends cut; one without blanks stays as it is."""
    parts = piece.split()
    return " ".join(parts[not at_start : len(parts) - (not at_end)]) if len(parts) > 2 else piece


def training_texts(labelled: DataFrame) -> dict[str, str]:
    """Sample text per language of `labelled` (doc_id, text, lang): words between single blanks.

    Distinct texts are drawn by hash, so copies do not crowd out others; each gives an equal
    share, from a place that its hash tells.  SAMPLE_TEXTS and LANGUAGE_CHARS bound what a
    language sends to the driver.  Rows without lang, letters or doc_id are not drawn.
    """
    fit = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    fit = fit.select("lang", "doc_id", "text", F.xxhash64("text").alias("h"))
    hashed = fit.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.max(F.char_length("text")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    drawn = hashed.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS).select("lang", "h", "doc_id", "n").collect()
    if not drawn:
        return {}
    lengths: dict[str, list[int]] = {}
    for r in drawn:
        lengths.setdefault(r["lang"], []).append(r["n"])
    share = {lang: equal_share(ns, LANGUAGE_CHARS) for lang, ns in lengths.items()}
    pieces = [(r["lang"], r["h"], r["doc_id"], 1 + r["h"] % max(1, r["n"] - share[r["lang"]] + 1), share[r["lang"]], r["n"]) for r in drawn]
    wanted = labelled.sparkSession.createDataFrame(pieces, "lang string, h long, doc_id long, start int, share int, n int")
    joined = fit.join(F.broadcast(wanted), ["lang", "h", "doc_id"]).select("lang", "h", "start", "share", "n", F.expr("substring(text, start, share)").alias("text"))
    texts = {}
    for r in sorted(joined.dropDuplicates(["lang", "h"]).collect(), key=lambda r: (r["lang"], r["h"])):
        piece = _whole_words(r["text"], r["start"] == 1, r["start"] + r["share"] > r["n"])
        texts[r["lang"]] = texts.get(r["lang"], " ") + "".join(w + " " for w in words_of(piece))
    return {k: t[:LANGUAGE_CHARS] for k, t in texts.items()}


def _parser(texts: dict[str, str]) -> CrossParser:
    return held(("parser", tuple(sorted(texts.items()))), lambda: CrossParser(texts))


def with_language(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1), from the whole text alone.

    Null texts and those without a letter are `und` with score 0, and so is everything
    when there is no training text.  All columns are kept, whatever their names; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(texts)  # at most LANGUAGE_CHARS characters a language

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(column: pa.Array) -> pa.Array:
        parser = _parser(shared.value)
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        return pa.array([dict(zip(("lang_pred", "score"), parser.predict(t.as_py()))) for t in column], kind)

    return docs.withColumn("__judged", judge(F.col(text))).select(*docs.columns, "__judged.*")


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    It learns only from documents whose crc32(doc_id as text) mod 4 is not 2 (null doc_ids
    are never drawn); those with 2 are held out.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    held = crc_of_id(F.col("doc_id")) % 4 == 2
    texts = training_texts(rows.where(~held))
    judged = with_language(rows.select("doc_id", "text"), texts)
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score")
