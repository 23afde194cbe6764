"""Segments of many texts at once: each distinct one is coded once, and its codes are dealt to its places."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are cut at a time; a longer text is cut alone.
CUT_BYTES = 4 << 20


def portions(texts: Iterable[str | None], limit: int = CUT_BYTES) -> Iterator[list[str]]:
    """The texts in order, a few at a time; null is empty."""
    own, held = [], 0
    for text in texts:
        text = text or ""
        if own and held + len(text) > limit:
            yield own
            own, held = [], 0
        own.append(text)
        held += len(text)
    if own:
        yield own


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each starts and the last one ends."""
    laid = pa.array(texts, pa.large_binary())
    bounds, data = (np.frombuffer(b or b"", t) for b, t in zip(laid.buffers()[1:], (np.int64, np.uint8)))
    return data[: bounds[len(texts)]], bounds[: len(texts) + 1]


def distinct(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of each segment's text, and the distinct texts; a segment ends where the next begins."""
    offsets = np.append(begins, len(data))
    segments = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data))
    coded = pc.dictionary_encode(segments)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def dealt(numbers: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each segment in turn, and where those of each segment begin and the last ones end.

    Values of the text with number k are `values[bounds[k] : bounds[k + 1]]`.
    """
    sizes = np.diff(bounds)[numbers]
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    places = np.repeat(bounds[:-1][numbers] - ends[:-1], sizes)
    places += np.arange(len(places))
    return values[places], ends
