"""Elias-Fano sequences: non-decreasing numbers in about 2 + log2(universe / n) bits each."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sIqqqq")
_MAGIC = b"EFS1"
#: A position of the upper bits is kept for every so many values.
SAMPLE = 256


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing 64-bit integers; the smallest is stored on its own."""
    values = np.asarray(values, np.int64)
    n = len(values)
    base = int(values[0]) if n else 0
    rest = (values - base).astype(np.uint64)
    last = int(rest[-1]) if n else 0
    low_bits = max(0, (last // n).bit_length() - 1) if n else 0
    high = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(high[-1]) // 8 + 1 if n else 0, np.uint8)
    np.bitwise_or.at(upper, high >> 3, (1 << (high & 7)).astype(np.uint8))
    shifts = np.arange(low_bits, dtype=np.uint64)
    lower = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
    samples = high[::SAMPLE].astype("<u8") if len(upper) >= 1 << 29 else high[::SAMPLE].astype("<u4")
    head = _HEAD.pack(_MAGIC, low_bits, n, base, len(lower), len(upper))
    return head + lower.tobytes() + upper.tobytes() + samples.tobytes()


class EliasFano:
    """Reads an encoded sequence; ``select`` decodes only the part that is asked for."""

    def __init__(self, data: bytes):
        magic, self.low_bits, self.n, self.base, lower, upper = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano sequence")
        at = _HEAD.size
        self.lower = np.frombuffer(data, np.uint8, lower, at)
        self.upper = np.frombuffer(data, np.uint8, upper, at + lower)
        self.samples = np.frombuffer(data, "<u8" if upper >= 1 << 29 else "<u4", offset=at + lower + upper)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.slice(i, i + 1)[0])

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1."""
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.int64)
        first = int(self.samples[i // SAMPLE])
        k = -(-j // SAMPLE)
        stop = int(self.samples[k]) if k < len(self.samples) else len(self.upper) * 8
        bits = np.unpackbits(self.upper[first >> 3 : (stop >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits[first & 7 :])[i % SAMPLE : i % SAMPLE + j - i] + first
        high = (ones - np.arange(i, j)).astype(np.int64)
        if not self.low_bits:
            return high + self.base
        from_bit = i * self.low_bits
        part = np.unpackbits(self.lower[from_bit >> 3 : (j * self.low_bits + 7) >> 3], bitorder="little")
        part = part[from_bit & 7 :][: (j - i) * self.low_bits].reshape(-1, self.low_bits)
        low = part.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return (high << self.low_bits) + low + self.base
