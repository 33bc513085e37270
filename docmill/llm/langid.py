"""Language identification with a linear-chain conditional random field (Lafferty, McCallum and Pereira 2001).

Every word of a sentence gets a language; emissions are learned weights of hashed byte n-grams of the word with
marks at its ends (so affixes too) and of lexicon entries, transitions are learned, and forward-backward gives each
word's marginals. A document's language is the one with the largest mean marginal over its words, which also shows
how much of a code-switched text is in each language. Training sentences are also spliced from two languages,
so that transitions between languages are seen.

The model is fitted on the driver from a bounded sample of labelled documents. Prediction is one pass over the
texts in blocks of about 256 KB; no sentence of ordinary length is cut, and a document's blocks are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.worker import released
from docmill.llm.words import mix
from docmill.plans.shared import bounded_batches, written

_STEP = 1 << 18
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n\r"]] = True
GRAMS = (2, 3, 4)


def words_of(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, sentence) of every word in UTF-8 bytes; sentences end at . ! ? and line ends, and at breaks."""
    inside = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    cut[breaks] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    sentence = np.cumsum(_END[data] | cut[:-1])[starts] if len(starts) else starts
    return starts, ends, sentence


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, first occurrence, number of each word in these)."""
    bases = np.full(max(1, len(data)), 0x9E3779B97F4A7C15, np.uint64)
    bases[0] = 1
    power = np.cumprod(bases, dtype=np.uint64)
    inverse = np.full(max(1, len(data)), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.unique(h, return_index=True, return_inverse=True)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of the n-grams, hashed to that many bits, of words given by their bytes."""
    n = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(n)))
    text = np.zeros(at[-1] + max(GRAMS), np.uint32)
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(at[-1]) - at[word]
    real = (place > 0) & (place < n[word] - 1)
    text[: at[-1]][real] = data[(starts[word] + place - 1)[real]]
    text[at[:-1]], text[at[1:] - 1] = 1, 2
    out_w, out_f = [], []
    for g in GRAMS:
        fits = place <= n[word] - g
        i = np.flatnonzero(fits)
        h = np.full(len(i), g, np.uint32)
        for k in range(g):
            h = (h ^ text[i + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        out_w.append(word[i])
        out_f.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
    return np.concatenate(out_w), np.concatenate(out_f)


def forward_backward(emit: np.ndarray, sentence: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals of every word, expected transitions, log partition) for log potentials of words in sentences.

    All sentences go forward together, the longest first, one word at a time.
    """
    n, k = emit.shape
    new = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    length = np.diff(np.concatenate((new, [n])))
    order = np.argsort(-length, kind="stable")
    new, length = new[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    top = emit.max(axis=1, keepdims=True)
    e, t = np.exp(emit - top), np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty(n, e.dtype)
    now = e[new]
    for i in range(length[0]):
        at = new[: active[i]] + i
        if i:
            now = (now[: active[i]] @ t) * e[at]
        s = now.sum(axis=1)
        now = now / s[:, None]
        alpha[at], scale[at] = now, s
    moved = np.zeros((k, k))
    after = np.zeros((0, k), e.dtype)
    for i in range(length[0] - 1, -1, -1):
        at = new[: active[i]] + i
        b = np.ones((len(at), k), e.dtype)
        if len(after):
            b[: len(after)] = after @ t.T
            moved += alpha[at[: len(after)]].T.astype(float) @ after * t
        beta[at] = b
        if i:
            after = b * e[at] / scale[at][:, None]
    return alpha * beta, moved, float(np.log(scale).sum() + top.sum())


class Model:
    """Labels, weights of hashed n-grams, a lexicon of word hashes with weights, and transitions, all numpy."""

    def __init__(self, labels: list[str], bits: int, lexicon: np.ndarray):
        k = len(labels)
        self.labels, self.bits, self.lexicon = labels, bits, lexicon
        self.grams = np.zeros((1 << bits, k), np.float32)
        self.entries = np.zeros((len(lexicon) + 1, k), np.float32)  # the last: not in the lexicon
        self.trans = np.zeros((k, k), np.float32)

    def entry(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def emissions(self, n: int, word: np.ndarray, feature: np.ndarray, entry: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(word, self.grams[feature, j], n) for j in range(self.grams.shape[1])], axis=1)
        return (out / np.maximum(1, np.bincount(word, minlength=n))[:, None] * 4 + self.entries[entry]).astype(np.float32)

    def marginals(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, marginals) of every word."""
        starts, ends, sentence = words_of(data, breaks)
        if not len(starts):
            return starts, np.zeros((0, len(self.labels)))
        h, first, number = distinct_words(data, starts, ends)
        w, f = word_features(data, starts[first], ends[first], self.bits)
        emit = self.emissions(len(h), w, f, self.entry(h))
        return starts, forward_backward(emit[number], sentence, self.trans)[0]


def train(texts: list[str], langs: list[str], *, bits: int = 16, lexicon_size: int = 2000, steps: int = 40, rate: float = 0.15, spliced: float = 0.3, seed: int = 11) -> Model:
    """Fits a Model to whole texts of known language by Adam on the regularised log likelihood."""
    labels = sorted(set(langs))
    k = len(labels)
    rng = np.random.default_rng(seed)
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    starts, ends, sentence = words_of(data, at)
    gold = np.array([labels.index(x) for x in langs])[np.searchsorted(at, starts, "right") - 1]
    # Splices the first half of some sentences to the second half of others, of any language.
    new = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    spans = [(a, b) for a, b in zip(new, np.append(new[1:], len(starts)), strict=True)]
    rng.shuffle(spans)
    many = int(len(spans) * spliced) // 2 * 2
    parts = [np.arange(a, b) for a, b in spans[many:]]
    for (a, b), (c, d) in zip(spans[:many:2], spans[1:many:2], strict=True):
        parts += [np.concatenate((np.arange(a, (a + b + 1) // 2), np.arange((c + d) // 2, d))), np.concatenate((np.arange(c, (c + d) // 2), np.arange((a + b + 1) // 2, b)))]
    parts = [p for p in parts if len(p)]
    take, sentence = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    starts, ends, gold = starts[take], ends[take], gold[take]
    h, first, number = distinct_words(data, starts, ends)
    model = Model(labels, bits, np.sort(h[np.argsort(-np.bincount(number), kind="stable")[:lexicon_size]]))
    word, feature = word_features(data, starts[first], ends[first], bits)
    entry = model.entry(h)
    per = np.maximum(1, np.bincount(word, minlength=len(h)))
    truth = np.zeros((len(h), k))
    np.add.at(truth, (number, gold), 1)
    same = sentence[1:] == sentence[:-1]
    moved_truth = np.zeros((k, k))
    np.add.at(moved_truth, (gold[:-1][same], gold[1:][same]), 1)
    params = [model.grams, model.entries, model.trans]
    m, v = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
    for step in range(1, steps + 1):
        emit = model.emissions(len(h), word, feature, entry)
        marg, moved, _ = forward_backward(emit[number], sentence, model.trans)
        less = truth - np.stack([np.bincount(number, marg[:, j], len(h)) for j in range(k)], axis=1)
        by = less / per[:, None] * 4
        grads = [np.stack([np.bincount(feature, by[word, j], 1 << bits) for j in range(k)], axis=1), np.stack([np.bincount(entry, less[:, j], len(model.entries)) for j in range(k)], axis=1), moved_truth - moved]
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g / len(number) - 1e-7 * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
    return model


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.utf8_lower(batch.column(1).cast(pa.large_string()).fill_null(""))
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            sums, words = np.zeros((len(text), len(model.labels))), np.zeros(len(text), np.int64)
            row, first = 0, int(offsets[0])
            while row < len(text):
                # A block ends at a document's end, or inside a very long one at white space.
                end = int(offsets[max(row + 1, int(np.searchsorted(offsets, first + _STEP, "right")) - 1)])
                if end - first > 2 * _STEP:
                    end = first + _STEP
                    while end < offsets[row + 1] and data[end] not in (0x20, 0x0A):
                        end += 1
                part = data[first:end]
                starts, marg = model.marginals(part, np.clip(offsets[row:] - first, 0, len(part)))
                doc = np.searchsorted(offsets, starts + first, "right") - 1
                for j in range(sums.shape[1]):
                    sums[:, j] += np.bincount(doc, marg[:, j], len(text))
                words += np.bincount(doc, minlength=len(text))
                first = end
                row = int(np.searchsorted(offsets, first, "right")) - 1 if first < offsets[-1] else len(text)
            best = sums.argmax(axis=1)
            share = sums[np.arange(len(text)), best] / np.maximum(1, words)
            letters = words > 0
            for i in np.flatnonzero(letters):  # bytes beyond ASCII aren't always letters
                part = data[offsets[i] : offsets[i + 1]]
                if not (_LETTER[:128][part[part < 128]]).any() and not any(c.isalpha() for c in text[int(i)].as_py()):
                    letters[i] = False
            lang = [model.labels[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(np.where(letters, np.minimum(1.0, share), 0.0))], ["id", "version", "lang_pred", "score"])

    return run


#: Texts that a label has in the sample at least, however many labels there are.
LEAST_ROWS = 20


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_label: int, max_chars: int, max_rows: int) -> tuple[list[str], list[str]]:
    """Whole texts of labelled documents outside the held-out fold, of every label: the per_label first of at most max_chars in a hash order of ids.

    With many labels, each has max_rows / labels of them, but LEAST_ROWS at least. A label whose short texts are fewer and
    together of less than max_chars also has its shortest long texts, up to the one with which all are of max_chars.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 4
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), fold.alias("fold")).where("lang is not null and text is not null and fold <> 2")
    labels = max(1, known.select("lang").distinct().count())
    per_label = min(per_label, max(LEAST_ROWS, max_rows // labels))
    size = F.length("text")
    order = Window.partitionBy("lang").orderBy(F.when(size > max_chars, size).otherwise(0), F.xxhash64(F.lit(3), F.col("id")), "id", "text")
    fit = known.where(F.col("text").rlike(r"\p{L}")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = fit.withColumn("size", size).withColumn("before", before).where((F.col("size") <= max_chars) | (F.col("before") < max_chars))
    rows = sorted((r["lang"], r["id"], r["text"]) for r in fit.select("lang", "id", "text").collect())
    return [r[2] for r in rows], [r[0] for r in rows]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_label: int = 200, max_chars: int = 20_000, max_rows: int = 10_000) -> DataFrame:
    """(id_col, version, held_out, lang_pred, score) for every row of docs.

    Learns from text and lang of rows whose crc32(id as text) mod 4 is not 2: whole texts of every language
    there, at most per_label for each and fewer if that would be more than max_rows, see training_sample(). held_out is that this remainder is 2 (null ids:
    false, and never learned from). Texts that are null or without letters are ``und`` with score 0; if nothing can
    be learned, so are all. score is the share of the document's words, by marginals, in lang_pred; ties go to the
    first label. version, a hash of the text, tells rows that share an id apart. Other columns are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    text = F.col(text_col).cast("string")
    texts, langs = training_sample(docs, id_col, text_col, lang_col, per_label, max_chars, max_rows)
    if not texts:
        return docs.select(F.col(id_col), F.xxhash64(text).alias("version"), held_out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("version"))
    with bounded_batches(docs.sparkSession):
        out = written(rows.mapInArrow(released(_predict(train(texts, langs))), f"id {kind}, version long, lang_pred string, score double"), "languages")
    return out.withColumnRenamed("id", id_col).select(id_col, "version", held_out.alias("held_out"), "lang_pred", "score")
