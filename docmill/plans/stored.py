"""The engine's index on shared storage: versions in folders of their own, each of segments, and a pointer to what counts.

A new version is written beside the old one, and a new segment beside the others of its version; the pointer is replaced at the end,
so that a lost driver leaves the old index whole, and what is done again overwrites what it had left. The version before the
last stays for those who still read it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.schema import CHUNK_SCHEMA
from docmill.operators import graph as graphs
from docmill.operators import knn, segments
from docmill.operators.graph import Graph
from docmill.operators.knn import Provider
from docmill.operators.lexical import FIELDS, Lexical, build_lexical, build_tfidf, latest, tokens_of
from docmill.plans.changes import FILES
from docmill.plans.search import HybridIndex, build_hybrid
from docmill.plans.shared import BROADCAST_ROWS, PACKED, kept_near, packed, sized, written
from docmill.sources import store
from docmill.sources.files import delete, exists, folders, read_text, write_text

POINTER = "current.json"
#: Segments of a version, after which a new version is due.
MOST_SEGMENTS = 16

_DOCUMENTS = "id string, source_id string, path string, n long"
_DEAD = "id string, segment int"


@dataclass
class Indexes:
    hybrid: HybridIndex
    tfidf: Lexical
    graph: Graph


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says of the version that counts; None if there is none."""
    there = f"{path}/index/{POINTER}"
    return json.loads(read_text(spark, there)) if exists(spark, there) else None


def _point(spark: SparkSession, path: str, told: dict) -> None:
    write_text(spark, f"{path}/index/{POINTER}", json.dumps(told))


def _put(at: str, chunks: DataFrame, lexical: Lexical, tfidf: Lexical, vectors: DataFrame, there: bool = False) -> None:
    """The tables of a segment. Chunks are in ranges of ids and postings in ranges of terms, so that lookups skip most of them. there: chunks and vectors are in their place."""
    if not there:
        store.in_ranges(chunks, lexical.chunks, "id").write.options(**PACKED).mode("overwrite").parquet(f"{at}/chunks")
    chunks.select("id", "source_id", "path", F.size(tokens_of(FIELDS)).cast("long").alias("n")).write.mode("overwrite").parquet(f"{at}/documents")
    store.save_lexical(lexical, f"{at}/lexical")
    store.save_lexical(tfidf, f"{at}/tfidf")
    if not there:
        store.save_vectors(vectors, f"{at}/vectors")


def build(chunks: DataFrame, path: str, provider: Provider, analyzer: str = "porter", files: DataFrame | None = None, marks: dict[str, int] | None = None) -> None:
    """The index of chunks, stored as save() does, without a copy of chunks and vectors beside: they are written to their place at once, chunks in ranges of ids."""
    spark, version = chunks.sparkSession, uuid.uuid4().hex
    at = f"{path}/index/{version}/0"

    def keep(df: DataFrame, name: str) -> DataFrame:
        if name == "latest-chunks":
            df.write.options(**PACKED).mode("overwrite").parquet(f"{at}/chunks")
            return spark.read.schema(df.schema).parquet(f"{at}/chunks")
        if name == "vectors":
            store.save_vectors(df, f"{at}/vectors")
            return store.load_vectors(spark, f"{at}/vectors")
        return packed(df, name)

    # The window over ids, by which the last of a chunk is found, keeps these ranges and sorts within them.
    hybrid = build_hybrid(chunks.repartitionByRange("id"), provider, analyzer, keep=keep, stored=True)
    save(Indexes(hybrid, build_tfidf(hybrid.chunks, packed, stored=True), graphs.build_graph(hybrid.chunks)), path, files, marks, version)


def save(found: Indexes, path: str, files: DataFrame | None = None, marks: dict[str, int] | None = None, begun: str | None = None) -> None:
    """Writes all tables as a new version of one segment. files: the manifest of the files that were indexed; marks: see add(); begun: see build()."""
    spark, version = found.hybrid.chunks.sparkSession, begun or uuid.uuid4().hex
    old = current(spark, path)
    at = f"{path}/index/{version}/0"
    _put(at, found.hybrid.chunks, found.hybrid.lexical, found.tfidf, found.hybrid.vectors, begun is not None)
    store.save_graph(found.graph, f"{at}/graph")
    if files is not None:
        files.write.mode("overwrite").parquet(f"{at}/files")
    counts = segments.counts_of(found.hybrid.lexical)
    _point(spark, path, {"version": version, "before": old and old["version"], "made_by": found.hybrid.made_by, "segment": 0, "chunks": counts.chunks, "tokens": counts.tokens, "dead": 0, "graph": 0, "files": files is not None, "marks": marks or {}})
    for name in folders(spark, f"{path}/index"):
        if name not in (POINTER, version, old and old["version"]) and not name.startswith("."):
            delete(spark, f"{path}/index/{name}")


def _parts(spark: SparkSession, path: str, told: dict) -> list[str]:
    return [f"{path}/index/{told['version']}/{i}" for i in range(told["segment"] + 1)]


def _dead(spark: SparkSession, path: str, told: dict) -> DataFrame | None:
    if not told["dead"]:
        return None
    rows = spark.read.schema(_DEAD).parquet(f"{_parts(spark, path, told)[-1]}/dead")
    return F.broadcast(rows) if told["dead"] <= BROADCAST_ROWS else rows


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of the files that the stored index was made from, if it was made from files."""
    told = current(spark, path)
    return spark.read.schema(FILES).parquet(f"{_parts(spark, path, told)[-1]}/files") if told and told.get("files") else None


def load(spark: SparkSession, path: str, provider: Provider, expansions: DataFrame | None = None) -> Indexes:
    """The stored tables; nothing is read before it is asked for."""
    told = current(spark, path)
    if told is None:
        raise FileNotFoundError(f"no index at {path}; build it first")
    parts, dead = _parts(spark, path, told), _dead(spark, path, told)
    counts = segments.Counts(told["chunks"], told["tokens"])
    table = lambda name, schema: segments.living([spark.read.schema(schema).parquet(f"{p}/{name}") for p in parts], dead)
    index = lambda name: segments.merged([store.load_lexical(spark, f"{p}/{name}") for p in parts], dead, counts)
    vectors = segments.living([store.load_vectors(spark, f"{p}/vectors") for p in parts], dead)
    hybrid = HybridIndex(table("chunks", CHUNK_SCHEMA), index("lexical"), vectors, provider, expansions, told["made_by"] and tuple(told["made_by"]))
    return Indexes(hybrid, index("tfidf"), store.load_graph(spark, f"{parts[told['graph']]}/graph"))


def add(spark: SparkSession, path: str, provider: Provider, new: DataFrame, touched: DataFrame, files: DataFrame | None = None, mark: tuple[str, int] | None = None) -> None:
    """Adds a segment of new chunks to the stored index. Chunks of touched(source_id, path), and those that new ones replace, die.

    Of new chunks with one id the last counts. Texts that the index has a vector of aren't embedded again. files: the manifest as it is now, else it
    stays. mark: a writer's name and the number of what it adds; what isn't after its last number has been added before and isn't again.
    Only what is new is written, besides the manifest, the list of the dead and, if components are concerned, the graph.
    """
    told = current(spark, path)
    marks = told.get("marks", {})
    if mark is not None and mark[1] <= marks.get(mark[0], -1):
        return
    parts, dead = _parts(spark, path, told), _dead(spark, path, told)
    k = told["segment"] + 1
    at = f"{path}/index/{told['version']}/{k}"
    analyzer = store.load_lexical(spark, f"{parts[0]}/lexical").analyzer
    new = written(latest(new), "new-chunks")
    many = len(new.select("id").take(store.SMALL + 1)) > store.SMALL
    keep = packed if many else kept_near
    lexical, tfidf = build_lexical(new, analyzer, keep=keep, positions=True, stored=many), build_tfidf(new, keep=keep, stored=many)
    known = [store.load_vectors(spark, f"{p}/vectors") for p in parts]
    vectors = written(knn.embed_chunks(new, provider, segments.living(known, None)), "new-vectors")
    _put(at, new, lexical, tfidf, vectors)
    documents = [spark.read.schema(_DOCUMENTS).parquet(f"{p}/documents") for p in parts]
    again = segments.numbered_segments(documents).join(sized(touched.select("source_id", "path").distinct()), ["source_id", "path"], "left_semi").select("id").union(new.select("id"))
    gone = written(segments.died(documents, dead, again), "died")
    lost = gone.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    all_dead = gone.select("id", "segment")
    (all_dead if dead is None else all_dead.unionByName(dead)).write.mode("overwrite").parquet(f"{at}/dead")
    files = manifest(spark, path) if files is None else files
    if files is not None:
        files.write.mode("overwrite").parquet(f"{at}/files")
    counts = segments.counts_of(lexical)
    after = told | {"segment": k, "chunks": told["chunks"] - lost["chunks"] + counts.chunks, "tokens": told["tokens"] - lost["tokens"] + counts.tokens, "dead": told["dead"] + lost["chunks"], "files": files is not None, "marks": marks | ({mark[0]: mark[1]} if mark else {})}
    every = [spark.read.schema(CHUNK_SCHEMA).parquet(f"{p}/chunks") for p in [*parts, at]]
    component = segments.numbered_segments([c.where("chunk_class = 'component'").select("id") for c in every])
    if component.where(F.col("segment") == k).take(1) or component.join(sized(gone.select("id", "segment")), ["id", "segment"], "left_semi").take(1):
        new_dead = spark.read.schema(_DEAD).parquet(f"{at}/dead")
        store.save_graph(graphs.build_graph(segments.living(every, new_dead if after["dead"] else None)), f"{at}/graph")
        after["graph"] = k
    _point(spark, path, after)
