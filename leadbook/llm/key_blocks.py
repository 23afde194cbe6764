"""Sets of 64-bit keys as compressed blocks, cut by the part of the key space that owns them.

An operator that needs a fact about every distinct key of the corpus (how often, in how
many texts) sends one block per chunk of documents and part instead of one row per key.  A
common key is then once in a chunk's block however often its documents have it.
"""

from __future__ import annotations

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences with equal bytes side by side, whose leading zeros compress."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_keys(data: bytes) -> np.ndarray:
    flat = unpack(data, "u1")
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def by_part(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Indexes of sorted keys by owning part, in order of part; within a part they stay sorted."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[ix[0]]), ix) for ix in np.split(order, cuts) if len(ix)]
