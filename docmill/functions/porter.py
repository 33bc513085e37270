"""Porter's stemmer (Porter 1980) and accent folding, as a pandas UDF over terms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of steps 2, 3 and 4 of the published algorithm.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """w as c (consonant) and v (vowel) by letter."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[i - 1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _has_vowel(w: str) -> bool:
    return "v" in _shape(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short_end(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replaced(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, other in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + other if _measure(stem) > least else w
    return w


@lru_cache(1 << 18)
def stem(w: str) -> str:
    """The stem of a lower-case word; words with other than a-z, and those of two letters, are left alone."""
    if len(w) <= 2 or len(w) > 64 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed") and len(w) > 3:
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, STEP2, 0)
    w = _replaced(w, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            cut = 3 if suffix in ("sion", "tion") else len(suffix)  # the s or t stays
            if _measure(w[:-cut]) > 1:
                w = w[:-cut]
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def fold(w: str) -> str:
    """w without accents."""
    if w.isascii():
        return w
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def stemmed(c: Column) -> Column:
    """Each term folded and stemmed; the distinct terms of a batch are worked out once."""

    @F.pandas_udf("string")
    def run(terms: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(terms)
        found = pd.Series([stem(fold(t)) for t in distinct] + [None], dtype=object)
        return found.iloc[codes].reset_index(drop=True)

    return run(c)


def stemmed_all(c: Column) -> Column:
    """Arrays of terms, those of several parts with spaces between, each part folded and stemmed."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def of(terms) -> list[str]:
            for t in terms:
                if t not in known:
                    known[t] = " ".join([stem(fold(w)) for w in t.split(" ")])
            return [known[t] for t in terms]

        return pd.Series([None if ts is None else of(ts) for ts in lists], dtype=object)

    return run(c)
