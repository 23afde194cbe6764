"""Token ids of whole texts with the `tokenizers` library, one memo of segments per Python worker.

A text is cut only where both tokenizer families start a new pre-token whatever
surrounds it: before a run of blanks that follows a non-blank, and behind a run of
letters.  Each segment then has the same ids alone as inside its text, so the
library encodes a segment once and the memo answers its other uses.  The memo is
asked once for each distinct segment of a few megabytes of texts.  Texts with
characters for which the cut is not proven go through the library whole.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from leadbook.llm.segments import dealt, distinct, laid_out, portions
from leadbook.llm.worker_cache import held

# Entries of each of the two generations of a worker's memo, and the longest segment that it keeps.
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_OTHER_SAFE = " \t\n!-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷"
_UNPROVEN = re.compile(f"[^{_LETTERS}{_OTHER_SAFE}]")
_WORD = re.compile(f" ?[{_LETTERS}]+")
_BLANKS = " \t\n"
# What a character of at most two bytes of UTF-8 is to the cut.
_BLANK, _LETTER, _OTHER = range(3)
_KINDS = np.array([_BLANK if chr(c) in _BLANKS else _LETTER if re.match(f"[{_LETTERS}]", chr(c)) else _OTHER for c in range(0x800)], np.uint8)


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """Segment -> its ids as little-endian 32-bit bytes.

    A full memo becomes the older generation, and what that one held and nobody asked for
    since is let go; an answer found there moves back.
    """

    def __init__(self, tokenizer: Tokenizer, entries: int):
        self.entries = entries
        self.tokenizer, self.model, self.shown = tokenizer, tokenizer.model, _byte_characters()
        self.older: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        packed = self.older.get(segment)
        if packed is None:
            packed = self._coded(segment)
        if len(segment) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[segment] = packed
        return packed

    def _coded(self, segment: str) -> bytes:
        word = segment.removeprefix(" ")
        if word.isascii() and word.isalpha():  # one pre-token: straight to the library's merges
            ids = [t.id for t in self.model.tokenize("Ġ" + word if len(word) < len(segment) else word)]
        elif _WORD.fullmatch(segment):
            ids = [t.id for t in self.model.tokenize(segment.encode().decode("latin-1").translate(self.shown))]
        else:
            ids = self.tokenizer.encode(segment, add_special_tokens=False).ids if segment else []
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes, equal to the library's for the whole text.

    A text that holds the string of an added token goes to the library whole, which codes it
    as that token.  A null or empty text has no ids.  Fewer `memo_entries` take less memory and more time.
    """

    def __init__(self, path: str, memo_entries: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.cuts, self.lower = _cut_rule(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        # An added token that is looked for in the normalized text may be hidden in any other one.
        if any(t.get("normalized") for t in spec.get("added_tokens", [])):
            self.cuts = False
        self.memo = _Memo(self.tokenizer, memo_entries or MEMO_ENTRIES)

    def encode(self, text: str | None) -> bytes:
        return b"".join(ids.tobytes() for ids, _ in self.encode_many([text]))

    def encode_many(self, texts: Iterable[str | None], end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For a few texts at a time, in order: the ids of all, and where each text's begin and the last one's end.

        `end_id` goes behind the ids of every text.
        """
        for own in portions(texts):
            ids, bounds = self._encoded(own)
            if end_id is not None:
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            yield ids, bounds

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        shown = [self._shown(t) for t in texts]
        data, bounds = laid_out([t.encode() for t, _ in shown])
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        begins = _begins(data, bounds, [k for k, (_, whole) in enumerate(shown) if whole])
        numbers, parts = distinct(data, begins)
        if self.cuts and self.lower:  # this family drops blanks
            parts = [p.lstrip(_BLANKS) for p in parts]
        coded = list(map(self.memo.__getitem__, parts))
        values, places = laid_out(coded)
        ids, ends = dealt(numbers, values.view("<u4"), places // 4)
        return ids, ends[np.searchsorted(begins, bounds)]

    def _shown(self, text: str) -> tuple[str, bool]:
        """A text as it is cut, and whether it goes to the library whole instead."""
        cut = text.lower() if self.lower else text
        # What lowering makes an added token is none to the library, but its segment would be.
        if not self.cuts or any(t in text or t in cut for t in self.added) or _UNPROVEN.search(text) or (self.lower and _UNPROVEN.search(cut)):
            return text, True
        return cut, False


def _begins(data: np.ndarray, bounds: np.ndarray, wholes: list[int]) -> np.ndarray:
    """Where segments begin in the bytes of texts between `bounds`; each of `wholes` is one segment.

    A segment begins with a text, with a run of blanks, and behind a run of letters that
    begins a word (all between blanks) and goes on with something else.
    """
    kinds = _KINDS[data]
    wide = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
    kinds[wide] = kinds[wide + 1] = _KINDS[(data[wide] & 31).astype(np.int64) << 6 | data[wide + 1] & 63]
    starts = np.unique(bounds[:-1][np.diff(bounds) > 0])
    blank, letter = kinds == _BLANK, kinds == _LETTER
    behind_blank, behind_letter = np.empty_like(blank), np.empty_like(letter)
    behind_blank[1:], behind_letter[1:] = blank[:-1], letter[:-1]
    behind_blank[starts], behind_letter[starts] = True, False
    begin = blank & ~behind_blank
    begin[starts] = True
    ahead_letter = np.append(letter[1:], False)
    ahead_letter[starts[1:] - 1] = False
    runs, ends = np.flatnonzero(letter & ~behind_letter), np.flatnonzero(letter & ~ahead_letter) + 1
    inner = ends[behind_blank[runs] & ~np.append(behind_blank, True)[ends] & (np.append(kinds, _BLANK)[ends] == _OTHER)]
    begin[inner] = True
    for k in wholes:
        begin[bounds[k] + 1 : bounds[k + 1]] = False
    return np.flatnonzero(begin)


def _cut_rule(spec: dict) -> tuple[bool, bool]:
    """Whether the cut is proven for a tokenizer file, else whole texts go to the library; whether it lowers texts and drops blanks."""
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and before.get("type") == "ByteLevel":
        if before.get("use_regex", True) and not before.get("add_prefix_space"):
            return True, False
    kinds = [p.get("type") for p in before.get("pretokenizers", [])]
    folds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if kinds == ["Split", "ByteLevel"] and folds == ["NFC", "Replace", "Lowercase"]:
        split = before["pretokenizers"][0]
        if split.get("behavior") == "Removed" and split.get("invert") and "\\p{L}" in str(split["pattern"]):
            return True, True
    return False, False


def encoder(path: str, memo_entries: int | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file, with its memo."""
    return held(("encoder", path, memo_entries), lambda: Encoder(path, memo_entries))
