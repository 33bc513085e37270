"""The chunk store: Parquet by source, or JSON lines; and the graph's and the indexes' tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.schema import CHUNK_SCHEMA, as_chunks
from docmill.functions.text import uuid5
from docmill.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, REACH_SCHEMA, Graph, reach_of
from docmill.operators.lexical import Lexical, blocks_of, counted, documents_of, postings_of, terms_of
from docmill.plans.shared import PACKED
from docmill.sources.files import delete, exists, read_text, write_text


def save_chunks(chunks: DataFrame, path: str, source_ids: list[str] | None = None) -> None:
    """Replaces the store, or with source_ids only these sources' partitions: files of other sources aren't touched."""
    rows = as_chunks(chunks.withColumn("indexed_at", F.current_timestamp().cast("timestamp_ntz")))
    writer = rows.write.options(**PACKED).mode("overwrite").partitionBy("source_id")
    if source_ids is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{path}/chunks")


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, f"{path}/chunks"):
        return spark.createDataFrame([], CHUNK_SCHEMA)
    return as_chunks(spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(present, chunk_count, indexed_at): one row."""
    there = exists(spark, f"{path}/chunks")
    return load_chunks(spark, path).agg(F.lit(there).alias("present"), F.count("*").alias("chunk_count"), F.max("indexed_at").alias("indexed_at"))


def chunks_to_json(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.to_json(F.struct(*chunks.columns)).alias("json"))


def chunks_from_json(rows: DataFrame) -> DataFrame:
    """Chunks from JSON; absent fields get their defaults, an unknown chunk type is overview."""
    from docmill.functions.vocabulary import CHUNK_TYPES

    out = as_chunks(rows.select(F.from_json("json", CHUNK_SCHEMA).alias("c")).select("c.*"))
    return out.withColumn("chunk_type", F.when(F.col("chunk_type").isNull() | F.col("chunk_type").isin(CHUNK_TYPES), F.col("chunk_type")).otherwise("overview"))


def save_graph(graph: Graph, path: str) -> None:
    """Nodes and edges, these also by either end; in ranges of nodes, so that a scan for few of them skips the others."""
    graph.nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    reach_of(graph.edges).repartitionByRange("node", "other").sortWithinPartitions("node", "other").write.mode("overwrite").parquet(f"{path}/reach")


def load_graph(spark: SparkSession, path: str) -> Graph | None:
    if not exists(spark, f"{path}/edges"):
        return None
    reach = spark.read.schema(REACH_SCHEMA).parquet(f"{path}/reach") if exists(spark, f"{path}/reach") else None
    return Graph(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges"), reach)


_POSTINGS = "id string, source_id string, seq long, n int, term string, tf long"
_PLACES = ", at array<int>"
_BLOCKS = "term string, base long, docs array<short>, tfs array<int>"
_DOCUMENTS = "no long, id string, source_id string, seq long, n int"


#: Chunks up to which a table is written as one file, without looking for ranges first.
SMALL = 1000


def in_ranges(rows: DataFrame, chunks: int, *by: str) -> DataFrame:
    """rows in ranges of columns, sorted within them; those of few chunks in one."""
    return (rows.coalesce(1) if chunks <= SMALL else rows.repartitionByRange(*by)).sortWithinPartitions(*by)


def save_lexical(index: Lexical, path: str) -> None:
    """Postings in ranges of terms, so that a scan for few terms skips most row groups.

    They are shuffled and written in blocks with the numbers of chunks; ids, sources and lengths stand in a table of the chunks, once each. Frequencies are
    those of the blocks. An index of few chunks, such as most segments, has rows instead, so that searches of many such need no joins.
    """
    few, write = index.chunks <= SMALL, lambda df, name: df.write.options(**PACKED).mode("overwrite").parquet(f"{path}/{name}")
    if few:
        postings = index.postings.select("id", "source_id", F.col("seq").cast("long").alias("seq"), "n", "term", F.col("tf").cast("long").alias("tf"), *(["at"] if "at" in index.postings.columns else []))
        write(in_ranges(postings, index.chunks, "term", "id"), "postings")
        write(in_ranges(index.terms, index.chunks, "term"), "terms")
    else:
        blocks = blocks_of(index)
        write(documents_of(blocks).withColumn("seq", F.col("seq").cast("long")), "documents")
        write(in_ranges(terms_of(blocks), index.chunks, "term", "base"), "postings")
    write_text(index.postings.sparkSession, f"{path}/statistics.json", json.dumps({"chunks": index.chunks, "mean": float(index.mean), "analyzer": index.analyzer, "positions": "at" in index.postings.columns, "blocks": not few}))


def load_lexical(spark: SparkSession, path: str) -> Lexical:
    s = json.loads(read_text(spark, f"{path}/statistics.json"))
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    if s.get("blocks"):
        blocks = table("postings", _BLOCKS + (_PLACES if s["positions"] else ""))
        postings, terms = postings_of(blocks, table("documents", _DOCUMENTS)), counted(blocks)
    else:  # a row for each posting: few chunks, or a former version's
        postings, terms = table("postings", _POSTINGS + (_PLACES if s.get("positions") else "")), table("terms", "term string, df long")
    return Lexical(postings, terms, s["chunks"], s["mean"], s["analyzer"])


_VECTORS = "id string, point_id string, source_id string, embedding array<float>, provider string, dim int, digest string"


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors with the UUID that names each point, and the digest of what was embedded, if that is known."""
    digest = F.col("digest") if "digest" in vectors.columns else F.lit(None).cast("string").alias("digest")
    vectors.select("id", uuid5(F.col("id")).alias("point_id"), "source_id", "embedding", "provider", "dim", digest).write.options(**PACKED).mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_VECTORS).parquet(path)


def upsert_vectors(new: DataFrame, path: str) -> DataFrame:
    """Merges vectors (id, ...) into the table at path; a new vector replaces one of its id. Returns the merged rows, to be written beside."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("id").orderBy(F.desc("_new"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def last_seq(chunks: DataFrame) -> int:
    """The greatest number of a chunk, -1 if there are none."""
    found = chunks.agg(F.max("seq")).first()[0]
    return -1 if found is None else found


def clear(spark: SparkSession, path: str) -> None:
    delete(spark, path)
