"""Benchmark decontamination with a positional inverted index, by DataFrame operations only.

1. ``build_index`` stores the postings (document, position, term) of every benchmark term in all documents.
2. Of the terms of each window of consecutive item words, the two rarest by their counts in the index are
   looked up. Their lists, adjusted by the term's offset in the item, are intersected: what is left are
   alignments (document, item, document position less item position), a small part of the corpus.
3. The lists of all other item terms are intersected with these alignments. Runs of matching positions of at
   least a window's length are occurrences of its windows.

The index is dealt by document, as it was read: no term's list is ever in one task. Joins with the terms and
alignments are broadcast if a count shows that they are small; beyond that they shuffle, and Spark splits what
a common term would make uneven. Counts are combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.plans.shared import release, sized, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased, and so A-Z are parts of words here.
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(c: Column) -> Column:
    """c with A-Z lower-cased. Strings that full lower-casing leaves alone, most words, skip the slow way."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, UPPER, LOWER))


def pieces(text: Column) -> Column:
    """What separators leave of a text, in order: its words, and maybe an empty piece at either end."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), _SPLIT)


def n_words(text: Column) -> Column:
    w = pieces(text)
    return (F.size(w) - F.when(F.element_at(w, 1) == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)).cast("long")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Tells rows apart that share an id but not a text."""
    return [F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("version")]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, id, n, place, term): the words of every item that has an id; item is a key of id and text."""
    words = F.filter(F.transform(pieces(F.col(text_col)), ascii_lower), lambda w: w != "")
    rows = items.where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("item"), F.col(id_col).cast("string").alias("id"), words.alias("words")).distinct()
    return rows.select("item", "id", F.size("words").alias("n"), F.posexplode("words").alias("place", "term"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc, version, place, term_id) of the terms (term, term_id) in docs, as a table in the shared folder."""
    tokens = docs.select(*_row_key(id_col, text_col), F.posexplode(pieces(F.col(text_col))).alias("place", "token"))
    tokens = tokens.select("doc", "version", "place", ascii_lower(F.col("token")).alias("term"))
    return written(tokens.join(sized(terms), "term").select("doc", "version", "place", "term_id"), "postings")


def _windows(places: DataFrame, window: int) -> DataFrame:
    """places with each window start that covers them, and the window's length."""
    n = F.least(F.lit(window), F.col("n"))
    first, last = F.greatest(F.lit(0), F.col("place") - n + 1), F.least(F.col("place"), F.col("n") - n)
    return places.withColumn("length", n).withColumn("start", F.explode(F.sequence(first, last)))


def _ranked(places: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    order = Window.partitionBy("item", "start").orderBy("count", "place")
    return _windows(places.join(counts, "term_id"), window).withColumn("rank", F.row_number().over(order))


def phrase_hits(index: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(doc, version, place, item): document places inside an occurrence of a window of an item.

    places: (item, n, place, term_id), the words of the items.
    """
    counts = index.groupBy("term_id").count()
    rare = written(_ranked(places, counts, window).where("rank <= 2").select("item", "term_id", F.col("place").alias("at"), F.least("length", F.lit(2)).alias("need")).distinct(), "rare-terms")
    aligned = index.join(sized(rare), "term_id").groupBy("doc", "version", "item", (F.col("place") - F.col("at")).alias("shift"))
    aligned = aligned.agg(F.count_distinct("at").alias("met"), F.min("need").alias("need")).where("met >= need").drop("met", "need")
    aligned = written(aligned, "alignments")
    keys = sized(aligned.select("doc", "version").distinct())
    lists = index.join(keys, index.doc.eqNullSafe(keys.doc) & (index.version == keys.version), "left_semi")
    wanted = aligned.join(places, "item").select(F.col("doc").alias("d"), F.col("version").alias("v"), "item", "n", "shift", F.col("place").alias("at"), (F.col("shift") + F.col("place")).alias("p"), F.col("term_id").alias("t"))
    met = wanted.join(lists, wanted.d.eqNullSafe(lists.doc) & (wanted.v == lists.version) & (wanted.p == lists.place) & (wanted.t == lists.term_id)).select("doc", "version", "item", "n", "shift", "at", "place").distinct()
    run = Window.partitionBy("doc", "version", "item", "shift")
    met = met.withColumn("run", F.col("at") - F.row_number().over(run.orderBy("at")))
    met = met.withColumn("length", F.count("*").over(Window.partitionBy("doc", "version", "item", "shift", "run")))
    hits = written(met.where(F.col("length") >= F.least(F.lit(window), F.col("n"))).select("doc", "version", "place", "item").distinct(), "hits")
    release(rare, aligned)
    return hits


def near_matches(index: DataFrame, places: DataFrame, window: int, slop: int) -> DataFrame:
    """(doc, version, item, start): windows whose distinct words all occur within window + slop words of a document, in any order.

    Starts from the postings of each window's rarest word and looks the others up around them.
    """
    counts = index.groupBy("term_id").count()
    ranked = written(_ranked(places, counts, window).select("item", "start", "length", "term_id", "rank"), "ranked-terms")
    need = ranked.groupBy("item", "start").agg(F.count_distinct("term_id").alias("need"))
    heads = ranked.where("rank = 1").select("item", "start", "length", "term_id").join(need, ["item", "start"])
    heads = index.join(sized(heads), "term_id").select("doc", "version", F.col("place").alias("at"), "item", "start", "length", "need")
    wanted = heads.join(sized(ranked.select("item", "start", F.col("term_id").alias("t")).distinct()), ["item", "start"])
    lists = index.select(F.col("doc").alias("d"), F.col("version").alias("v"), "place", "term_id")
    span = F.col("length") + slop
    around = wanted.join(lists, wanted.doc.eqNullSafe(lists.d) & (wanted.version == lists.v) & (wanted.t == lists.term_id)).where(F.abs(F.col("place") - F.col("at")) < span)
    # Every stretch of the span that holds the rarest word at ``at`` begins at one of these places.
    first = F.explode(F.sequence(F.greatest(F.col("place") - span, F.col("at") - span) + 1, F.least("place", "at")))
    found = around.withColumn("first", first).groupBy("doc", "version", "item", "start", "at", "first", "need").agg(F.count_distinct("t").alias("met"))
    out = written(found.where("met = need").select("doc", "version", "item", "start").distinct(), "near-matches")
    release(ranked)
    return out


def _terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, places) of item_terms(), with terms numbered by their hashes."""
    places = items.withColumn("term_id", F.xxhash64("term"))
    return places.select("term", "term_id").distinct(), places


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """judged() without version: (id_col, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs."""
    return judged(docs, benchmark, **names).drop("version")


def judged(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(id_col, version, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Windows
    are ``window`` consecutive item words; an item of fewer, but not none, is one window. A document word inside any
    occurrence of a window is hit. items_sha256 is over the ids of the items with occurring windows, sorted as
    strings and joined by commas; no items: of the empty string. Null and wordless texts have no words and no
    hits. Items without an id or without words match nothing; items that share an id count once. Rows that share
    an id, or have none, are judged one by one; version, a hash of the text, tells them apart. Other columns are ignored.
    """
    items = written(item_terms(benchmark, item_id_col, item_text_col), "items")
    terms, places = _terms(items)
    index = build_index(docs, terms, id_col, text_col)
    hits = phrase_hits(index, places.select("item", "n", "place", "term_id"), window)
    ids = items.select("item", "id").distinct()
    words = hits.groupBy("doc", "version").agg(F.count_distinct("place").alias("n_hit"))
    met = hits.select("doc", "version", "item").distinct().join(sized(ids), "item").groupBy("doc", "version").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    met = words.join(met.withColumnsRenamed({"doc": "doc_", "version": "version_"}), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("version") == F.col("version_"))).select(F.col("doc").alias("doc_"), F.col("version").alias("version_"), "n_hit", "ids")
    met = sized(written(met, "met"))
    release(index, hits, items)
    out = docs.select(*_row_key(id_col, text_col), n_words(F.col(text_col)).alias("n_words"))
    out = out.join(met, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("version") == F.col("version_")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("doc").alias(id_col), "version", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
