"""Reports how well search finds what is known to be there: known-item queries over all documents, by source.

Of every document whose id is divisible by ``every`` the ``terms`` terms that tell it best from the others (greatest tf-idf) are asked
of the index, as a user would who remembers a few words of it, and BM25 ranks all documents for them. The report has a row for each
document asked for: the words, the rank at which search finds it among the ``k`` best (null: it doesn't), its score, and the document
that stands first. It is written by source; a run overwrites the report before it.

    python -m jobs.search_report --config jobs/search_report.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.vocabulary import STOPWORDS
from docmill.operators.lexical import Lexical, bm25_best, build_lexical
from docmill.plans.shared import spread, written
from jobs.common import log, main

SETTINGS = {"documents": None, "out": None, "every": 50, "terms": 5, "k": 10}
REPORT = "doc_id long, words string, n_words int, rank int, reciprocal_rank double, score double, first_id long, first_score double, n_found int, source string"


def telling_terms(index: Lexical, asked: DataFrame, n: int) -> DataFrame:
    """(query_id, term, place): the n terms of greatest tf-idf of each of asked(id), weights rounded, equal ones by term.

    Stopwords and single characters aren't asked for.
    """
    rows = index.postings.where((F.length("term") >= 2) & ~F.col("term").isin(sorted(STOPWORDS))).join(asked.select("id"), "id", "left_semi").join(index.terms, "term")
    weight = F.round(F.col("tf") / F.col("n") * F.ln(F.lit(float(index.chunks)) / F.col("df")), 9)
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return rows.withColumn("weight", weight).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(F.col("id").alias("query_id"), "term", "place")


def report_of(documents: DataFrame, every: int = 50, terms: int = 5, k: int = 10) -> DataFrame:
    """The report's rows for documents (doc_id, text, source). Ids are expected to be distinct; rows without one are left out.

    Null texts count as documents without words; so do those without any word to ask for, whose row has no words and no rank.
    """
    chunks = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source_id"), F.col("doc_id").cast("long").alias("seq"), F.col("text").alias("content"))
    index = build_lexical(chunks, fields=("content",))
    asked = chunks.where(F.col("id") % every == 0).select("id", "source_id")
    words = written(telling_terms(index, asked, terms), "telling-terms")
    found = bm25_best(index, words.select("query_id", "term"), k)
    own = found.groupBy("query_id").agg(
        F.min(F.when(F.col("id") == F.col("query_id"), F.struct("rank", "score"))).alias("own"), F.min(F.struct("rank", "id", "score")).alias("first"), F.count("*").cast("int").alias("n_found"),
    )
    said = words.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]), " ").alias("words"), F.count("*").cast("int").alias("n_words"))
    rows = asked.join(said.join(own, "query_id"), F.col("id") == F.col("query_id"), "left")
    return rows.select(
        F.col("id").alias("doc_id"), F.coalesce("words", F.lit("")).alias("words"), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.col("own.rank").alias("rank"), (1 / F.col("own.rank")).alias("reciprocal_rank"), F.col("own.score").alias("score"),
        F.col("first.id").alias("first_id"), F.col("first.score").alias("first_score"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.col("source_id").alias("source"),
    )


def report(spark: SparkSession, documents: str, out: str, every: int = 50, terms: int = 5, k: int = 10) -> DataFrame:
    """Writes the report of the Parquet table documents to out, by source, logs a summary, and gives the report read back."""
    rows = spark.read.parquet(documents)
    log.info("%d documents read from %s", rows.count(), documents)
    report_of(spread(rows), every, terms, k).write.mode("overwrite").partitionBy("source").parquet(out)
    rows = spark.read.schema(REPORT).parquet(out)
    n = rows.agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.count_if(F.col("rank") == 1).alias("first"), F.avg(F.coalesce("reciprocal_rank", F.lit(0.0))).alias("mean")).first()
    log.info("%d rows written to %s: %d documents found among the first %d, %d as the first; mean reciprocal rank %s", n["n"], out, n["found"], k, n["first"], None if n["mean"] is None else round(n["mean"], 4))
    return rows


if __name__ == "__main__":
    main("search_report", __doc__.splitlines()[0], report, SETTINGS)
