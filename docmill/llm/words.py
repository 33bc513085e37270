"""Words of many texts at once, as 64-bit hashes, with numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < max(1, n):
        steps = np.full(max(n, _STEP), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of every word, its hash); no word runs over a position in breaks."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    cut[breaks] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its words, maximal runs of other than ASCII white space, A-Z lower-cased, as uint64 hashes. Null: none.

    Memory is some tens of bytes for each byte of about 256 KB of text, or of the longest single word, and 8 bytes a word.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _STEP, "right")) - 1)
        first, last = int(offsets[row]), int(offsets[to])
        if last - first <= 2 * _STEP:
            starts, h = _hashes(data[first:last], offsets[row:to] - first)
            at = np.searchsorted(starts, offsets[row : to + 1] - first)
            for i in range(to - row):
                yield h[at[i] : at[i + 1]]
        else:  # one long text, in pieces that end at white space
            parts = []
            while first < last:
                end = min(first + _STEP, last)
                while end < last and not _SPACE[data[end]]:
                    gap = np.flatnonzero(_SPACE[data[end : end + _STEP]])
                    end = end + int(gap[0]) if len(gap) else min(end + _STEP, last)
                parts.append(_hashes(data[first:end], np.zeros(0, np.int64))[1])
                first = end
            yield np.concatenate(parts)
        row = to


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of size words; fewer words, but not none, are one run."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - size + 1)
    h = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h)
