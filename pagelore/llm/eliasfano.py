"""Elias-Fano coding of a non-decreasing sequence of non-negative integers.

A value is cut into `l` low bits, stored as they are, and a high part, stored as one set bit at place
high(i) + i of a bit array: about 2 + log2(u / n) bits a value. `select(i)` finds the i-th set bit with a
directory of one 32-bit place per 256 set bits and byte counts between them, `steps()` goes on from one directory
place to the next; no table of 64-bit offsets is kept or built.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

_HEAD = struct.Struct("<QQBQ")  # values, largest value, low bits, bytes of the high part
_STEP = 256
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


class EliasFano:
    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.places = n, top, low_bits, low, high, places

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n, dtype=np.int64)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        low = np.zeros(0, dtype=np.uint8)
        if l and n:
            low = np.packbits(((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, top, l, low, np.packbits(bits, bitorder="little"), ones[::_STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.top, self.low_bits, len(self.high)) + self.places.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at byte `at`, and the byte after it."""
        n, top, l, m = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        k, b = -(-n // _STEP), -(-n * l // 8)
        places = np.frombuffer(data, "<u4", k, at)
        low = np.frombuffer(data, np.uint8, b, at + 4 * k)
        high = np.frombuffer(data, np.uint8, m, at + 4 * k + b)
        return cls(n, top, l, low, high, places), at + 4 * k + b + m

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        word = int.from_bytes(self.low[a >> 3:(a + self.low_bits + 7) >> 3].tobytes(), "little")
        return (word >> (a & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, read from at most one directory step."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.places[i // _STEP]), i % _STEP
        byte = at >> 3
        first = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        if left >= int(_ONES[first]):
            left -= int(_ONES[first])
            byte += 1
            while True:  # whole blocks of bytes until the one that holds the bit
                c = np.cumsum(_ONES[self.high[byte:byte + 64]], dtype=np.int64)
                k = int(np.searchsorted(c, left, side="right"))
                if k < len(c):
                    left -= int(c[k - 1]) if k else 0
                    byte += k
                    first = int(self.high[byte])
                    break
                left -= int(c[-1])
                byte += len(c)
        for bit in range(8):
            if first >> bit & 1:
                if not left:
                    return ((byte * 8 + bit - i) << self.low_bits) | self._low(i)
                left -= 1
        raise ValueError("damaged high part")

    def steps(self) -> Iterator[np.ndarray]:
        """All values in order, those of one directory step at a time: a select cursor that never holds the whole sequence."""
        for i in range(0, self.n, _STEP):
            k = i // _STEP
            n = min(_STEP, self.n - i)
            first = int(self.places[k])
            last = int(self.places[k + 1]) if k + 1 < len(self.places) else 8 * len(self.high)
            bits = np.unpackbits(self.high[first >> 3:(last + 7) >> 3], bitorder="little")
            bits[:first & 7] = 0
            ones = np.flatnonzero(bits)[:n] + (first & ~7)
            v = (ones - np.arange(i, i + n)).astype(np.uint64) << np.uint64(self.low_bits)
            if self.low_bits:
                at = i * self.low_bits
                low = np.unpackbits(self.low[at >> 3:(at + n * self.low_bits + 7) >> 3], bitorder="little")[at & 7:(at & 7) + n * self.low_bits]
                v |= (low.reshape(n, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
            yield v

    def decode(self) -> np.ndarray:
        """All values as one array."""
        return np.concatenate([np.zeros(0, np.uint64), *self.steps()])
