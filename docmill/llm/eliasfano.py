"""Elias-Fano codes of non-decreasing whole numbers, with a select structure for any one of them.

Of n numbers up to u the low bits, about log2(u / n), stand packed side by side; the high parts are a bit vector in which number i
sets bit high(i) + i. That is at most 2 + log2(u / n) bits a number. For every SAMPLE-th set bit its place is kept as 32 bits, relative
to a 64-bit place for every SUPER samples, so that the i-th set bit is found by counting bits in a bounded stretch, and a
slice of numbers is decoded without what stands before it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SAMPLE, SUPER = 256, 1 << 12
_HEAD = struct.Struct("<QQQB7x")
#: Numbers whose low bits are packed at once: a multiple of eight.
BLOCK = 1 << 16
_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _packed(x: np.ndarray, width: int) -> np.ndarray:
    """The low bits of numbers, side by side."""
    if not width:
        return np.zeros(0, np.uint8)
    return np.packbits(((x[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")


@dataclass
class EliasFano:
    n: int
    least: int
    most: int
    width: int  # low bits of a number
    low: np.ndarray  # bytes
    high: np.ndarray  # bytes
    supers: np.ndarray  # uint64
    samples: np.ndarray  # uint32

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """Values: int64, non-decreasing. They may be negative: the first is taken off from all."""
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        if (values[1:] < values[:-1]).any():
            raise ValueError("the numbers must not fall")
        x = values.astype(np.uint64) - values[:1].astype(np.uint64)  # modulo 2^64, so that any two longs are apart by what they are
        u = int(x[-1])
        width = max(0, (u // n).bit_length() - 1)
        low = [_packed(x[k : k + BLOCK], width) for k in range(0, n, BLOCK)]
        places = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) >> 3) + 1, np.uint8)
        np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
        sampled = places[::SAMPLE].astype(np.uint64)
        supers = sampled[::SUPER]
        beyond = sampled - np.repeat(supers, SUPER)[: len(sampled)]
        if int(beyond.max()) >> 32:
            raise ValueError("too many numbers for one code")
        return cls(n, int(values[0]), int(values[-1]), width, np.concatenate(low), high, supers, beyond.astype(np.uint32))

    def select(self, i: int) -> int:
        """The place of the i-th set bit, counted from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // SAMPLE
        start = int(self.supers[k // SUPER]) + int(self.samples[k])
        left, byte = i - k * SAMPLE, start >> 3
        if not left:
            return start
        # Set bits from the sample's own bit on; the stretch grows until it holds enough of them.
        first, size = int(self.high[byte]) >> (start & 7), 64
        left -= bin(first).count("1") - 1
        if left <= 0:
            at = np.flatnonzero(np.unpackbits(np.array([first], np.uint8), bitorder="little"))[i - k * SAMPLE]
            return start + int(at)
        byte += 1
        while True:
            counts = np.cumsum(_POPULATION[self.high[byte : byte + size]])
            if counts[-1] >= left:
                at = int(np.searchsorted(counts, left))
                inside = left - (int(counts[at - 1]) if at else 0)
                bits = np.flatnonzero(np.unpackbits(self.high[byte + at : byte + at + 1], bitorder="little"))
                return ((byte + at) << 3) + int(bits[inside - 1])
            left, byte, size = left - int(counts[-1]), byte + size, 4 * size

    def _low(self, i: int, j: int) -> np.ndarray:
        if not self.width:
            return np.zeros(j - i, np.int64)
        first, last = i * self.width, j * self.width
        bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
        return (bits.reshape(-1, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1).astype(np.int64)

    def slice(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1."""
        if i >= j:
            return np.zeros(0, np.int64)
        first, last = self.select(i), self.select(j - 1)
        bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
        places = np.flatnonzero(bits[first & 7 :])[: j - i] + first
        return (((places - np.arange(i, j)) << self.width) | self._low(i, j)) + self.least

    def __getitem__(self, i: int) -> int:
        return int(((self.select(i) - i) << self.width) | int(self._low(i, i + 1)[0])) + self.least

    def find(self, value: int) -> int:
        """How many numbers are less than the value."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self[mid] < value else (low, mid)
        return low

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.least & (1 << 64) - 1, self.most & (1 << 64) - 1, self.width)
        parts = [self.low, self.high, self.supers.astype("<u8"), self.samples.astype("<u4")]
        return head + struct.pack("<4Q", *(len(p) for p in parts)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """(what stands at a place of the data, the place behind it)."""
        n, least, most, width = _HEAD.unpack_from(data, at)
        sizes = struct.unpack_from("<4Q", data, at + _HEAD.size)
        at += _HEAD.size + 32
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u8", "<u4"), strict=True):
            parts.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return cls(n, signed(least), signed(most), width, *parts), at
