"""Elias-Fano code of a non-decreasing sequence of unsigned integers, with select."""

from __future__ import annotations

import struct

import numpy as np

# Every SAMPLE-th set bit of the high part has its place stored, so a lookup scans a few bytes.
SAMPLE = 256

_HEAD = struct.Struct("<QQQQQQ")


class EliasFano:
    """n values below 2^64 in about n * (2 + log2(last / n)) bits.

    The low `width` bits of each value are stored as they are; the high part of
    value i is a set bit at place high + i.  value(i) finds the i-th set bit by the
    nearest sample and a scan of the bytes behind it.  An empty sequence is valid.
    """

    def __init__(self, n: int, width: int, base: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.base = n, width, base
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values)
        n = len(values)
        if not n:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, 0, empty, empty, np.zeros(0, "<u8"))
        base = int(values[0])
        if n > 1 and (values[1:] < values[:-1]).any():
            raise ValueError("an Elias-Fano sequence must not decrease")
        above = values.astype(np.uint64) - np.uint64(base % 2**64)
        width = max(0, (int(above[-1]) // n).bit_length() - 1)
        ones = (above >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones.astype(np.int64)] = 1
        low = np.zeros((n, width), np.uint8)
        for k in range(width):
            low[:, k] = (above >> np.uint64(k)) & np.uint64(1)
        high = np.packbits(bits, bitorder="little")
        return cls(n, width, base, np.packbits(low.ravel(), bitorder="little"), high, ones[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        parts = [a.tobytes() for a in (self.low, self.high, self.samples)]
        head = _HEAD.pack(self.n, self.width, self.base % 2**64, *map(len, parts))
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, base, *sizes = _HEAD.unpack_from(data)
        at, parts = _HEAD.size, []
        for size, kind in zip(sizes, ("u1", "u1", "<u8")):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, width, base, *parts)

    def _low(self, i: int) -> int:
        first, last = i * self.width, (i + 1) * self.width
        word = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return (word >> first % 8) & ((1 << self.width) - 1)

    def value(self, i: int) -> int:
        """The i-th value, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place // 8
        byte = int(self.high[at]) >> place % 8 << place % 8
        while byte.bit_count() <= left:
            left -= byte.bit_count()
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        one = at * 8 + (byte & -byte).bit_length() - 1
        return (one - i << self.width | self._low(i)) + self.base & 2**64 - 1

    def values(self) -> np.ndarray:
        """All values, as unsigned 64-bit integers."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)
        out = ones - np.arange(self.n, dtype=np.uint64) << np.uint64(self.width)
        if self.width:
            low = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
            for k in range(self.width):
                out |= low[:, k].astype(np.uint64) << np.uint64(k)
        return out + np.uint64(self.base)
