"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination and mixing, in this order.

Every stage takes (spark, docs, sf_dir) and works on all the rows that its predecessor kept; all but the last
return the columns of documents. run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import decontam, langid, minhash, mixing
from docmill.plans.shared import sized, spread, written

#: A document goes if less than this share of its words is in its main language, or if it has no letters.
MIN_SCORE = 0.4

#: SQL can't express the first stage, a trained model; the tests compare every stage with a brute-force version.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """The name, or one like it that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _version() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows named by (doc_id, version), one by one; equal rows are judged alike."""
    i, v = _free(docs, "gone_id"), _free(docs, "gone_version")
    gone = sized(written(gone.select(F.col("doc_id").alias(i), F.col("version").alias(v)).distinct(), "gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (_version() == F.col(v)), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: those with letters, of which one language has MIN_SCORE of the words.

    What goes is text that no model of one language should learn from: tables of numbers, and code-switched text in which no
    language prevails. Every language that is learned is kept, whatever the row's label says. Null and empty texts go.
    """
    found = langid.identify(docs)
    return _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < MIN_SCORE)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Of rows that share an id, the first by their other columns stays. Rows with a null id, and texts without words, link with nothing and
    all stay.
    """
    found = written(minhash.near_duplicates(docs), "near-duplicates")
    i = _free(docs, "gone_id")
    gone = sized(written(found.where("not kept").select(F.col("doc_id").alias(i)).distinct(), "gone"))
    kept = docs.join(gone, F.col("doc_id") == F.col(i), "left_anti")
    repeated = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(i)), "repeated")
    if not repeated.take(1):
        return kept
    again = sized(repeated)
    once = kept.join(again, F.col("doc_id") == F.col(i), "left_anti")
    rest = [c for c in docs.columns if c != "doc_id"]
    one = kept.join(again, F.col("doc_id") == F.col(i), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[F.col(c) for c in rest])).alias(i))
    return once.unionByName(one.select(*["doc_id" if c == "doc_id" else F.col(i)[c].alias(c) for c in docs.columns]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold any ten-word window of a benchmark item; rows that share an id, or have none, one by one."""
    return _without(docs, decontam.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each with how often: the columns of docs, size, copies, taken.

    Each row is taken by itself, equal ones too. Columns of docs that are called size, copies or taken give way.
    """
    taken = mixing.mix(docs, carry=docs.columns).where("taken > 0")
    return taken.select(*[F.col("carried")[c].alias(c) for c in docs.columns if c.lower() not in ("size", "copies", "taken")], "size", (F.col("taken") / F.col("size")).cast("long").alias("copies"), "taken")


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
