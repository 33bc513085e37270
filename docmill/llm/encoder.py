"""Texts to token ids by a tokenizer file, many at once.

A byte-level tokenizer cuts a text into pieces by a pattern and gives each piece to its model. Here the cuts of a whole batch are
found with numpy, from the classes of characters; each distinct piece is given to the library's model once, and what a worker has
seen it keeps. The ids are those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces whose ids an encoder keeps at most; beyond it begins anew.
KEPT = 300_000
# Byte-level pre-tokenizers cut by 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# and write these bytes as they are, all others as characters from 256 on.
_ONE, _TWO = "stmd", ("re", "ve", "ll")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BLANK = chr(_BYTES[32])

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_PLANE = 1 << 16


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each character of the first plane; UNKNOWN for those that not all versions of Unicode tell alike, and for all beyond."""

    def of(data, c: str) -> int:
        kind = data.category(c)
        if kind in ("Cn", "Cs", "Co"):
            return UNKNOWN
        return SPACE if c.isspace() and not "\x1c" <= c <= "\x1f" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)

    out = np.full(_PLANE + 1, UNKNOWN, np.uint8)
    for i in range(_PLANE):
        old, new = of(unicodedata.ucd_3_2_0, chr(i)), of(unicodedata, chr(i))
        out[i] = new if old == new else UNKNOWN
    return out


def characters(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code point, byte place) of every character of UTF-8 text."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    return points, np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def cuts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Does a piece begin at a character? first: does a text begin there?"""
    n = len(points)
    before = np.concatenate((kinds[:1], kinds[:-1]))
    new = (kinds != before) | first
    space = kinds == SPACE
    after_blank = np.concatenate(([False], points[:-1] == 32)) & ~first
    # A blank before a run of letters, numbers or others belongs to it; of more white space the last character stands alone.
    begin = new & (space | ~after_blank)
    last = np.concatenate((space[:-1] & ~space[1:] & ~first[1:], [False]))
    begin |= last
    marks = np.flatnonzero(begin & (points == 39))
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1]]
    next_one = points[marks + 1]
    short = np.isin(next_one, [ord(c) for c in _ONE])
    two = marks[~short]
    two = two[two + 2 < n]
    two = two[~first[two + 2]]
    pair = points[two + 1].astype(np.int64) << 32 | points[two + 2]
    two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in _TWO])]
    for at, size in ((marks[short], 2), (two, 3)):
        begin[at + 1] = False
        end = at + size
        begin[end[end < n]] = True
    return begin


class Encoder:
    """A tokenizer file. Texts go whole to the library if it isn't byte-level BPE, or if they hold an added token or unknown characters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.code = "I" if self.kind.itemsize == 4 else "H"
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        self.by_pieces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and told["normalizer"] is None and told["model"]["type"] == "BPE"
        self.added = [t["content"] for t in told["added_tokens"]]
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        known, tokenize = self.known, self.model.tokenize
        if len(known) > KEPT:
            known.clear()
        found = list(map(known.get, pieces))
        for i, ids in enumerate(found):
            if ids is None:
                p = pieces[i]
                shown = p.replace(" ", _BLANK) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTES)
                found[i] = known[p] = array(self.code, [t.id for t in tokenize(shown)]).tobytes()
        return found

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each, is a text odd) of texts; if any is odd, the first two are empty."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if texts.buffers()[2] is not None else pa.py_buffer(b"")
        offsets = offsets - offsets[0]
        points, at = characters(data.to_pybytes())
        begin = np.searchsorted(at, offsets)
        kinds = classes()[np.minimum(points, _PLANE)]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(begin, np.flatnonzero(kinds == UNKNOWN), "right") - 1] = True
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if odd.any():
            return np.zeros(0, self.kind), np.zeros(0, np.int64), odd
        first = np.zeros(len(points) + 1, bool)
        first[begin] = True
        starts = np.flatnonzero(cuts(points, kinds, first[:-1])) if len(points) else np.zeros(0, np.int64)
        bounds = np.concatenate((at[starts], [len(data)])).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), data).dictionary_encode()
        which = pieces.indices.to_numpy()
        found = self._ids(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(found), self.kind)
        ahead = np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.cumsum(each)
        place = np.repeat(ahead[which] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        return ids[place], np.diff(np.concatenate(([0], ends))[np.searchsorted(starts, begin)]), odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has). Null texts are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = np.ones(len(texts), bool)
        if self.by_pieces and len(texts):
            ids, sizes, odd = self._by_pieces(texts)
            if not odd.any():
                return ids, sizes
        whole = {int(i): self._whole(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        plain = np.flatnonzero(~odd)
        if len(plain):
            ids, sizes, _ = self._by_pieces(texts.take(pa.array(plain)))
            whole |= dict(zip(plain.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
        parts = [whole[i] for i in range(len(texts))]
        return np.concatenate([np.zeros(0, self.kind), *parts]), np.array([len(p) for p in parts], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker, so that tasks that follow know its pieces."""
    return Encoder(path)
