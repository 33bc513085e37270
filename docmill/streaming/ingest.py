"""Incremental indexing: a stream of new files, merged into the chunk store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.schema import CHUNK_SCHEMA
from docmill.operators.chunking import CHUNKERS
from docmill.operators.graph import build_graph
from docmill.operators.knn import Provider, hashing_provider
from docmill.operators.lexical import build_tfidf, latest
from docmill.plans import stored
from docmill.plans.indexing import numbered
from docmill.plans.search import build_hybrid
from docmill.plans.shared import sized, written
from docmill.sources import store
from docmill.sources.files import decoded, qualified


def stream_files(spark: SparkSession, root: str, source_id: str, extensions: tuple[str, ...], latin: bool = True) -> DataFrame:
    """Files below root as they appear, in the columns that chunkers take. Those that can't be decoded are left out."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    base = qualified(spark, root)
    rows = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    start = F.length(F.regexp_replace(F.lit(base), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")) + 2
    rows = rows.select(F.lit(source_id).alias("source_id"), F.substr(path, start).alias("path"), decoded(F.col("content"), latin).alias("content"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"), F.lit(False).alias("is_entrypoint"))
    return rows.where("content is not null").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(extensions)))


def _swapped(rows: DataFrame, store_path: str, name: str) -> None:
    """Writes rows beside the store and then swaps in the partitions of their sources, so that doing it again gives the same."""
    beside = f"{store_path}/merging-{name}"
    rows.write.mode("overwrite").parquet(beside)
    store.save_chunks(rows.sparkSession.read.schema(CHUNK_SCHEMA).parquet(beside), store_path, [])
    store.clear(rows.sparkSession, beside)


def merge_chunks(store_path: str, adapter: str):
    """A foreachBatch function: the chunks of a batch's files replace those of the same source and path, and come last in corpus order.

    Only the partitions of the batch's sources, which are few, are read and written.
    """
    chunker = CHUNKERS[adapter][1]

    def merge(batch: DataFrame, number: int) -> None:
        files = latest(batch.withColumn("_k", F.concat_ws(":", "source_id", "path")), "_k", "modified").drop("_k")
        touched = [r[0] for r in files.select("source_id").distinct().collect()]
        there = store.load_chunks(batch.sparkSession, store_path)
        new = numbered(chunker(files).withColumns({"source_no": F.lit(0), "adapter_no": F.lit(0)}), store.last_seq(there) + 1)
        old = there.where(F.col("source_id").isin(touched)).join(files.select("source_id", "path"), ["source_id", "path"], "left_anti").select(*new.columns)
        _swapped(old.unionByName(new), store_path, str(number))

    return merge


def merge_index(path: str, adapter: str, name: str, provider: Provider | None = None):
    """A foreachBatch function: the chunks of a batch's files become a segment of the index stored at path, or the index if there is none.

    Chunks of the same files die. The pointer to the index also keeps the number of the stream's last batch, under its name, so that
    a batch that comes again changes nothing, and one that was broken off is merged as if for the first time. Once there are
    many segments, the living are written as a new version.
    """
    chunker, provider = CHUNKERS[adapter][1], provider or hashing_provider()

    def merge(batch: DataFrame, number: int) -> None:
        spark, told = batch.sparkSession, stored.current(batch.sparkSession, path)
        if told and number <= told.get("marks", {}).get(name, -1):
            return
        files = written(latest(batch.withColumn("_k", F.concat_ws(":", "source_id", "path")), "_k", "modified").drop("_k"), "stream-files")
        old = stored.load(spark, path, provider) if told else None
        first = store.last_seq(old.hybrid.chunks) + 1 if old else 0
        new = numbered(chunker(files).withColumns({"source_no": F.lit(0), "adapter_no": F.lit(0)}), first)
        if old and told["segment"] < stored.MOST_SEGMENTS:
            return stored.add(spark, path, provider, new, files.select("source_id", "path"), mark=(name, number))
        chunks = new if old is None else old.hybrid.chunks.join(sized(files.select("source_id", "path")), ["source_id", "path"], "left_anti").select(*new.columns).unionByName(new)
        hybrid = build_hybrid(chunks, provider, stored=True)
        stored.save(stored.Indexes(hybrid, build_tfidf(hybrid.chunks, stored=True), build_graph(hybrid.chunks)), path, stored.manifest(spark, path), (told or {}).get("marks", {}) | {name: number})

    return merge


def forget_missing(spark: SparkSession, root: str, source_id: str, store_path: str) -> int:
    """Removes the chunks of files that are no longer below root; how many there were."""
    base = qualified(spark, root)
    start = F.length(F.regexp_replace(F.lit(base), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")) + 2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(F.substr(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/"), start).alias("path"))
    own = store.load_chunks(spark, store_path).where(F.col("source_id") == source_id)
    gone = own.join(files, "path", "left_anti").count()
    if gone and own.count() == gone:
        store.clear(spark, f"{store_path}/chunks/source_id={source_id}")
    elif gone:
        _swapped(own.join(files, "path", "left_semi").select(*own.columns), store_path, "forget")
    return gone


def follow(spark: SparkSession, root: str, source_id: str, adapter: str, store_path: str, checkpoint: str, once: bool = True, index: str | None = None):
    """Starts the stream; with ``once`` it ends when all files that are there have been merged.

    Into the chunk store, or with index, the stream's name, into the stored index instead.
    """
    merge = merge_chunks(store_path, adapter) if index is None else merge_index(store_path, adapter, index)
    writer = stream_files(spark, root, source_id, CHUNKERS[adapter][0], adapter in ("source", "python")).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
