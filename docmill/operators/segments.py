"""A lexical index in segments: each holds what was new at a time, and what counts is told by the rows that died since.

A segment is an index of its own chunks. A chunk that is written again, or removed, dies in the segment where it was; nothing is
rewritten. Statistics are those of the living: frequencies are added up over segments and lessened by those of dead
postings, which are worked out for the asked terms alone; numbers of chunks and tokens are kept as sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.lexical import Lexical
from docmill.plans.shared import sized


@dataclass
class Counts:
    """Of living chunks: how many, and their tokens."""

    chunks: int
    tokens: int

    @property
    def mean(self) -> float:
        return self.tokens / max(1, self.chunks)


def counts_of(index: Lexical) -> Counts:
    return Counts(index.chunks, round(index.mean * index.chunks))


def numbered_segments(parts: list[DataFrame]) -> DataFrame:
    """All rows, with the number of their segment."""
    return reduce(DataFrame.unionByName, [p.withColumn("segment", F.lit(i)) for i, p in enumerate(parts)])


def living(parts: list[DataFrame], dead: DataFrame | None) -> DataFrame:
    """The rows of segments(id, ...) but for dead(id, segment)."""
    if dead is None or len(parts) == 1:
        return reduce(DataFrame.unionByName, parts)
    return numbered_segments(parts).join(dead, ["id", "segment"], "left_anti").drop("segment")


def merged(parts: list[Lexical], dead: DataFrame | None, counts: Counts) -> Lexical:
    """One index of all segments' living chunks. A filter on terms reaches the scans of each segment."""
    if len(parts) == 1:
        return parts[0]
    postings = [p.postings for p in parts]
    terms = reduce(DataFrame.unionByName, [p.terms for p in parts])
    if dead is not None:
        gone = numbered_segments(postings).join(dead, ["id", "segment"], "left_semi")
        terms = terms.unionByName(gone.select("term", F.lit(-1).cast("long").alias("df")))
    terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return Lexical(living(postings, dead), terms, counts.chunks, counts.mean, parts[0].analyzer)


def died(documents: list[DataFrame], dead: DataFrame | None, again: DataFrame, n: str = "n") -> DataFrame:
    """(id, segment, n) of the living in segments(id, n) that are among again(id), written again or removed."""
    rows = numbered_segments(documents)
    rows = rows if dead is None else rows.join(dead, ["id", "segment"], "left_anti")
    return rows.join(sized(again.select("id").distinct()), "id", "left_semi").select("id", "segment", n)
