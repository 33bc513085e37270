"""Plans from sources to tables."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.schema import CHUNK_SCHEMA
from docmill.operators.chunking import CHUNKERS, IN_ORDER
from docmill.plans.shared import packed
from docmill.sources.config import Source
from docmill.sources.files import scan


def _parts(spark: SparkSession, source: Source, number: int, only: list[str] | None = None) -> list[DataFrame]:
    """The chunks of each adapter of a source in their order, by path and seq, the place in the file, with source_no and adapter_no.

    Only the listing is sorted where a chunker keeps the order of files: their contents are neither shuffled nor sorted.
    """
    out = []
    for i, adapter in enumerate(source.adapters):
        if adapter.type not in CHUNKERS:
            warnings.warn(f"source {source.id}: unknown adapter type {adapter.type!r}", stacklevel=2)
            continue
        extensions, chunker = CHUNKERS[adapter.type]
        latin = adapter.type in ("source", "python")
        if adapter.type == "compodoc":  # opens its file whatever the patterns say
            files = scan(spark, source.root, [adapter.config.get("json_path", "documentation.json")], [], source.id, source.entrypoints, latin, only)
        else:
            files = scan(spark, source.root, source.include_globs, source.exclude_globs, source.id, source.entrypoints, latin, only, list(extensions), adapter.type in IN_ORDER)
        files = files.where("error is null").drop("error", "extension")
        known = {k: v for k, v in adapter.config.items() if k in chunker.__code__.co_varnames[: chunker.__code__.co_argcount]}
        chunks = chunker(files, **known)
        chunks = chunks if adapter.type in IN_ORDER else chunks.orderBy("path", "seq", "id")
        out.append(chunks.withColumns({"source_no": F.lit(number), "adapter_no": F.lit(i)}))
    return out


def index_source(spark: SparkSession, source: Source, first: int = 0) -> DataFrame:
    """Chunks of a source: every adapter sees every file that it supports. Unknown adapters are warned of and left out."""
    return index_sources(spark, [source], first)


def index_sources(spark: SparkSession, sources: list[Source], first: int = 0, only: list[str] | None = None) -> DataFrame:
    """Chunks of all sources, or only of the files of these uris; seq numbers them from ``first`` in corpus order."""
    parts = [p for k, s in enumerate(sources) for p in _parts(spark, s, k, only)]
    return _numbered(reduce(DataFrame.unionByName, parts), first) if parts else spark.createDataFrame([], CHUNK_SCHEMA)


def numbered(chunks: DataFrame, first: int = 0) -> DataFrame:
    """seq: numbers without gaps in the order of source_no, adapter_no, path and the place in the file, which seq was. For chunks in any order: one shuffle into ranges."""
    return _numbered(chunks.orderBy("source_no", "adapter_no", "path", "seq", "id"), first)


def _numbered(chunks: DataFrame, first: int) -> DataFrame:
    """numbered() for chunks whose order within an adapter is that of their rows and partitions.

    They are written once, each with its place in its partition; its number is that and the sizes of the partitions before, a row for
    each of which is broadcast. release() of the result deletes what was written, once the numbered chunks are stored.
    """
    rows = packed(chunks.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "chunks")
    by = ["source_no", "adapter_no", "_part"]
    before = F.coalesce(F.sum("n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("_at").alias("_start")).select(*by, (before - F.col("_start")).alias("_before"))
    out = rows.join(F.broadcast(before), by).withColumn("seq", F.col("_before") + F.col("_at") + first)
    out = out.select(chunks.drop("source_no", "adapter_no").columns)
    out._written_at = rows._written_at
    return out
