"""Query expansion by a table (term, alt) of abbreviations and synonyms, one step, not transitive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import words
from docmill.functions.vocabulary import ABBREVIATIONS, SYNONYMS
from docmill.plans.shared import local_table


def expansion_rows(abbreviations: Iterable[tuple[str, str]] = ABBREVIATIONS, synonyms: Iterable[tuple[str, ...]] = SYNONYMS) -> list[tuple[str, str, int]]:
    """(term, alt, order). A full form leads back to the last of its abbreviations only."""
    pairs = list(abbreviations)
    alts = [*pairs, *{full: (full, short) for short, full in pairs}.values(), *((a, b) for group in synonyms for a in group for b in group if a != b)]
    return [(t, a, i) for i, (t, a) in enumerate(dict.fromkeys(alts))]


def expansions(spark: SparkSession, extra_abbreviations: Iterable[tuple[str, str]] = (), extra_synonyms: Iterable[tuple[str, ...]] = ()) -> DataFrame:
    """The table of built-in and custom expansions, lower-cased; as large as the lists given to the driver, and so broadcast."""
    low = lambda rows: [tuple(w.lower() for w in r) for r in rows]
    rows = expansion_rows([*ABBREVIATIONS, *low(extra_abbreviations)], [*SYNONYMS, *low(extra_synonyms)])
    return F.broadcast(local_table(spark, rows, "term string, alt string, n int"))


def expand_terms(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, place, term, step, n[, source]): every word of the queries with its expansions; step 0 is the word itself."""
    keep = [c for c in ("query_id", "source") if c in queries.columns]
    own = queries.select(*keep, F.posexplode(words("text")).alias("place", "word"))
    alt = own.join(table, own.word == table.term).select(*keep, "place", F.col("alt").alias("term"), F.lit(1).alias("step"), "n")
    return own.select(*keep, "place", F.col("word").alias("term"), F.lit(0).alias("step"), F.lit(0).alias("n")).unionByName(alt)


def expanded_few(rows: list[tuple], table: DataFrame) -> list[tuple]:
    """Like expanded_terms(), for a few (query_id, words[, source]) that the driver holds: distinct (query_id, term[, source])."""
    alts: dict[str, list[str]] = {}
    for r in table.collect():
        alts.setdefault(r["term"], []).append(r["alt"])
    return list(dict.fromkeys((q, t, *rest) for q, words_, *rest in rows for w in words_ for t in (w, *alts.get(w, ()))))


def expanded_terms(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, term[, source]): the distinct terms of each query."""
    return expand_terms(queries, table).drop("place", "step", "n").distinct()


def expanded_query(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, expanded): the words in order, each followed by its expansions, repeats dropped."""
    rows = expand_terms(queries, table).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "step", "n", "term"))).alias("rows"))
    return rows.select("query_id", F.array_join(F.array_distinct(F.transform("rows", lambda r: r["term"])), " ").alias("expanded"))
