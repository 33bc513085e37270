"""The best part of a text for a query, with the query's terms marked, as column expressions.

A window of so many tokens is scored by the different terms that it holds, and less by how often. The windows that are looked at
are, for each place of a term, the one that begins there, moved so that its terms stand in the middle, and the one that
begins with the sentence. The first of the best is shown as it stands in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import TERM, all_matches, let

# What another term, another occurrence, the beginning of the text and the beginning of a sentence are worth.
TERM_WORTH, AGAIN_WORTH, TEXT_START, SENTENCE_START = 1000, 1, 120, 100
#: What stands before a token that begins a sentence.
_SENTENCE = r"[.:][ \t\n\r]+\z"


def _hits(keys: Column, terms: Column) -> Column:
    """For each token an array of (at, term, size) for the terms that begin there."""
    parts = F.transform(terms, lambda t: F.split(t, " "))

    def of(key: Column, i: Column) -> Column:
        found = F.transform(parts, lambda p, k: F.struct(i.alias("at"), k.alias("term"), F.size(p).alias("size"), (F.element_at(p, 1) == key).alias("first"), p.alias("parts")))
        return F.transform(F.filter(found, lambda h: h["first"] & ((h["size"] == 1) | (F.slice(keys, i + 1, h["size"]) == h["parts"]))), lambda h: F.struct(h["at"].alias("at"), h["term"].alias("term"), h["size"].alias("size")))

    return F.transform(keys, of)


def _score(inside: Column) -> Column:
    different = F.size(F.array_distinct(F.transform(inside, lambda h: h["term"])))
    return TERM_WORTH * different + AGAIN_WORTH * (F.size(inside) - different)


def _start(hits: Column, gaps: Column, n: Column, window: int) -> Column:
    """The number of the first token shown."""
    inside = lambda start: F.flatten(F.slice(hits, start + 1, F.lit(window)))
    sentences = F.filter(F.transform(F.slice(gaps, 1, n), lambda g, i: F.when((i == 0) | g.rlike(_SENTENCE), i)), lambda i: i.isNotNull())

    def around(hit: Column) -> Column:
        def placed(found: Column) -> Column:
            last = F.element_at(found, -1)
            spare = F.lit(window) - (last["at"] + last["size"] - hit["at"])
            start = F.greatest(F.lit(0), F.least(hit["at"] - F.when(spare >= 0, F.floor(spare / 2)).otherwise(F.ceil(spare / 2)).cast("int"), n - window))
            return F.struct(_score(found).alias("score"), start.alias("start"))

        return let(inside(hit["at"]), placed)

    def sentence(hit: Column) -> Column:
        def placed(start: Column) -> Column:
            score = _score(inside(start)) + F.when(start == 0, TEXT_START).otherwise(SENTENCE_START)
            return F.when((n > window) & (start < hit["at"]), F.struct(score.alias("score"), start.alias("start")))

        return let(F.array_max(F.filter(sentences, lambda s: s <= hit["at"])), placed)

    candidates = F.flatten(F.transform(F.flatten(hits), lambda h: F.array(around(h), sentence(h))))
    ranked = F.transform(candidates, lambda c, i: F.when(c.isNotNull(), F.struct(c["score"].alias("score"), (-i).alias("order"), c["start"].alias("start"))))
    return F.coalesce(F.array_max(ranked)["start"], F.lit(0))


def _shown(tokens: Column, gaps: Column, hits: Column, n: Column, start: Column, window: int, mark: str) -> Column:
    end = F.least(start + window, n)
    inside = F.flatten(F.slice(hits, start + 1, F.lit(window)))

    def piece(token: Column, k: Column) -> Column:
        i = k + start
        covering = F.filter(inside, lambda h: (h["at"] <= i) & (i < h["at"] + h["size"]))
        opens = (F.size(covering) > 0) & ~F.exists(covering, lambda h: h["at"] < i)
        closes = (F.size(covering) > 0) & (~F.exists(covering, lambda h: h["at"] + h["size"] - 1 > i) | (i == end - 1))
        gap = F.when((k == 0) & (start > 0), "").otherwise(F.element_at(gaps, i + 1))
        return F.concat(gap, F.when(opens, mark).otherwise(""), token, F.when(closes, mark).otherwise(""))

    text = F.array_join(F.transform(F.slice(tokens, start + 1, F.lit(window)), piece), "")
    return F.concat(F.when(start > 0, "...").otherwise(""), text, F.when(end < n, "...").otherwise(F.element_at(gaps, -1)))


def best_snippet(content: Column, terms: Column, window: int = 32, mark: str = "**", analyzed: Callable[[Column], Column] | None = None, head: bool = False) -> Column:
    """The window of that many tokens of content that shows the most of the terms, which are marked; ellipses where it is cut.

    terms: an array of what the index has of the query's terms, those of several parts with single spaces between. analyzed turns an array of
    lower-cased tokens into terms, if they aren't these themselves. A text without any of the terms gives null, or its beginning with
    ``head``; a null gives null.
    """
    tokens, gaps = all_matches(content, TERM), F.split(content, TERM)
    keys = F.transform(tokens, F.lower)
    keys = keys if analyzed is None else analyzed(keys)
    bound = F.struct(tokens.alias("tokens"), gaps.alias("gaps"), keys.alias("keys"))

    def shown(b: Column) -> Column:
        n = F.size(b["tokens"])
        found = lambda hits: F.lit(True) if head else F.exists(hits, lambda h: F.size(h) > 0)
        return let(_hits(b["keys"], terms), lambda hits: F.when(found(hits), let(_start(hits, b["gaps"], n, window), lambda start: _shown(b["tokens"], b["gaps"], hits, n, start, window, mark))))

    return F.when(content.isNotNull(), let(bound, shown))
