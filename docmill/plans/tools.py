"""The engine: everything a client can ask, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import pascal_to_kebab, usage_snippet
from docmill.operators import expand, graph, knn, lexical
from docmill.plans import changes, stored
from docmill.plans.indexing import index_sources
from docmill.plans.search import HybridIndex, build_hybrid, hybrid_search
from docmill.plans.shared import few, local_table, release, sized, written
from docmill.sources import store
from docmill.sources.config import Source, load_sources, sources_table

# Kinds of source chunks, characters of a source hit that are shown, hits among which a component's files are looked for,
# and the tags by which the search for a component's users asks.
SOURCE_KINDS = ("source", "template", "stylesheet")
SHOWN, FILES_AMONG = 500, 20
USAGE_TAGS = ("<{}", "<app-{}", "<tds-{}")


class Engine:
    """Chunks with their hybrid index, TF-IDF index and component graph.

    Built from chunks, or opened from the index that a former engine stored at its path. A given graph takes the place of the
    one that chunks make.
    """

    def __init__(self, chunks: DataFrame, sources: list[Source] | None = None, provider: knn.Provider | None = None, analyzer: str = "porter", expanding: bool = True, path: str | None = None, known: graph.Graph | None = None):
        self.spark: SparkSession = chunks.sparkSession
        self.sources, self.path, self.stored, self.known = sources or [], path, chunks, known
        hybrid = build_hybrid(chunks, provider, analyzer, expand.expansions(self.spark) if expanding else None, stored=path is not None)
        self._take(stored.Indexes(hybrid, lexical.build_tfidf(hybrid.chunks, stored=path is not None), graph.kept(known or graph.build_graph(hybrid.chunks))))

    def _take(self, found: stored.Indexes) -> None:
        self.index: HybridIndex = found.hybrid
        self.chunks, self.tfidf, self.graph = found.hybrid.chunks, found.tfidf, found.graph

    def save(self) -> None:
        """Stores the index at the engine's path, with a manifest of the sources' files; an index without chunks leaves the stored one as it is."""
        if self.index.lexical.chunks:
            nothing = self.spark.createDataFrame([], changes.FILES)
            files = changes.manifest_of(changes.changes(self.spark, self.sources, nothing)) if self.sources else None
            stored.save(stored.Indexes(self.index, self.tfidf, self.graph), self.path, files)
            self._take(stored.load(self.spark, self.path, self.index.provider, self.index.expansions))

    @classmethod
    def open(cls, spark: SparkSession, path: str, sources: list[Source] | None = None, provider: knn.Provider | None = None, expanding: bool = True) -> Engine:
        """The engine over the index stored at path. Nothing is built, and tables are read as far as they are asked for."""
        self = cls.__new__(cls)
        self.spark, self.sources, self.path, self.known, self.stored = spark, sources or [], path, None, store.load_chunks(spark, path)
        self._take(stored.load(spark, path, provider or knn.hashing_provider(), expand.expansions(spark) if expanding else None))
        return self

    @classmethod
    def from_config(cls, spark: SparkSession, config: str, path: str | None = None, **options) -> Engine:
        """Indexes the sources of a configuration; with a path, chunks and index are stored there."""
        sources = load_sources(spark, config)
        chunks = index_sources(spark, sources)
        if path:
            store.save_chunks(chunks, path)
            release(chunks)
            chunks = store.load_chunks(spark, path)
        self = cls(chunks, sources, path=path, **options)
        if path:
            self.save()
        return self

    def _asked(self, *texts: str, source: str | None = None) -> DataFrame:
        rows = [(i, t, source) for i, t in enumerate(texts)]
        return local_table(self.spark, rows, "query_id int, text string, source string")

    def _named(self, name: str) -> DataFrame:
        return local_table(self.spark, [(name,)], "asked string")

    # Search and context.

    def search(self, query: str, source: str | None = None, top_k: int = 8) -> DataFrame:
        rows = hybrid_search(self.index, self._asked(query, source=source), top_k)
        return rows.select("id", "source_id", "path", "anchor", "title", "kind", "snippet", F.round("score", 4).alias("score"), "lexical_rank", "vector_rank", "rank").orderBy("rank")

    def get_context(self, source: str, path: str, anchor: str | None = None) -> DataFrame:
        """One row: the chunk at the anchor, else all of the file's chunks with blank lines between, else a message."""
        asked = local_table(self.spark, [(source, path, anchor or None)], "source_id string, path string, anchor string")
        return contexts(self.stored.where((F.col("source_id") == source) & (F.col("path") == path)), asked).select("content")

    def list_sources(self) -> DataFrame:
        return with_counts(sources_table(self.spark, self.sources), self.stored)

    def reload(self, source: str | None = None) -> DataFrame:
        """Indexes what has changed in the files of all sources, or of one. (source_id, chunk_count) of these sources then.

        A stored index that was made from files gets a segment of the changed files' chunks, which come last; other files aren't read. Without
        one, and once there are many segments, all is indexed again.
        """
        some = [s for s in self.sources if source in (None, s.id)]
        told = stored.current(self.spark, self.path) if self.path else None
        if told and told["files"] and told["segment"] < stored.MOST_SEGMENTS and self.known is None:
            self._refresh(some)
        else:
            self._rebuild(some, source)
        return counts_by_source(self.stored.where(F.col("source_id").isin([s.id for s in some])))

    def clear(self, source: str) -> int:
        """Takes a source out of the chunk store and the stored index; how many chunks it had. Its files count as new to a later reload."""
        own = self.stored.where(F.col("source_id") == source)
        n = own.count()
        if n and self.path and stored.current(self.spark, self.path):
            files = stored.manifest(self.spark, self.path)
            stored.add(self.spark, self.path, self.index.provider, own.limit(0), own.select("source_id", "path"), files if files is None else files.where(F.col("source_id") != source))
            store.clear(self.spark, f"{self.path}/chunks/source_id={source}")
            self.stored = store.load_chunks(self.spark, self.path)
            self._take(stored.load(self.spark, self.path, self.index.provider, self.index.expansions))
        return n

    def _refresh(self, some: list[Source]) -> None:
        spark, before = self.spark, stored.manifest(self.spark, self.path)
        found = changes.changes(spark, some, before)
        rows = few(found.where("change <> 'kept'").select("source_id", "path", "uri", "change"))
        if rows is None:
            return self._rebuild(some, None if len(some) == len(self.sources) else some[0].id)
        if not rows:
            return None
        touched = local_table(spark, [(r["source_id"], r["path"]) for r in rows if r["change"] != "added"], "source_id string, path string")
        ids = sorted({r["source_id"] for r in rows})
        new = index_sources(spark, [s for s in some if s.id in ids], store.last_seq(self.stored) + 1, [r["uri"] for r in rows if r["uri"] is not None])
        new = written(new, "reloaded")
        others = before.where(~F.col("source_id").isin([s.id for s in some]))
        stored.add(spark, self.path, self.index.provider, new, touched, others.unionByName(changes.manifest_of(found)))
        kept = self.stored.where(F.col("source_id").isin(ids)).join(F.broadcast(touched), ["source_id", "path"], "left_anti").select(new.columns)
        both = written(kept.unionByName(new), "reloaded-sources")
        store.save_chunks(both, self.path, ids)
        for gone in set(ids) - {r[0] for r in both.select("source_id").distinct().collect()}:
            store.clear(spark, f"{self.path}/chunks/source_id={gone}")
        self.stored = store.load_chunks(spark, self.path)
        self._take(stored.load(spark, self.path, self.index.provider, self.index.expansions))

    def _rebuild(self, some: list[Source], source: str | None) -> None:
        new = index_sources(self.spark, some, 0 if source is None else store.last_seq(self.stored) + 1)
        if self.path:
            store.save_chunks(new, self.path, None if source is None else [source])
            release(new)
            chunks = store.load_chunks(self.spark, self.path)
        else:
            chunks = new if source is None else self.stored.where(F.col("source_id") != source).unionByName(new)
        self.__init__(chunks, self.sources, self.index.provider, self.index.lexical.analyzer, self.index.expansions is not None, self.path, self.known)
        if self.path:
            self.save()

    # Components.

    def search_components(self, query: str, component: str | None = None, category: str | None = None, chunk_type: str | None = None, include_related: bool = False, top_k: int = 8) -> DataFrame:
        scores = lexical.tfidf_search(self.tfidf, self.chunks, self._asked(query), 5 * top_k)
        return graph.filtered_search(scores, self.chunks, self.graph, top_k, component, category, chunk_type, include_related).orderBy("rank")

    def get_component_info(self, component: str) -> DataFrame:
        return graph.component_info(self.graph, self.chunks, self._named(component))

    def list_component_categories(self) -> DataFrame:
        return graph.list_categories(self.graph).orderBy("seq").drop("seq")

    def explore_category(self, category: str, include_chunks: bool = False) -> DataFrame:
        return graph.explore_category(self.graph, self.chunks, category, include_chunks).orderBy("seq").drop("seq")

    def find_related_components(self, component: str, depth: int = 2, mode: str = "shortest") -> DataFrame:
        return graph.walk(self.graph, self._named(component), depth, mode).orderBy("distance", "name")

    # Source code.

    def search_source(self, query: str, language: str | None = None, file_type: str | None = None, component: str | None = None, top_k: int = 10) -> DataFrame:
        rows = hybrid_search(self.index, self._asked(query), 2 * top_k)
        shown = F.when(F.length("content") > SHOWN, F.concat(F.substring("content", 1, SHOWN), F.lit("..."))).otherwise(F.col("content"))
        return source_filter(rows, language, file_type, component).withColumn("snippet", shown).select("source_id", "path", "title", "language", "file_type", "component_name", "snippet", "score").orderBy(F.desc("score"), "path").limit(top_k)

    def get_component_source(self, component: str, include_template: bool = True, include_styles: bool = False) -> DataFrame:
        """(file_type, path, content, class_name, selector, related_files): the best hit for each wanted kind of file."""
        kinds = ["component", *(["template"] if include_template else []), *(["stylesheet"] if include_styles else [])]
        return best_files(hybrid_search(self.index, self._asked(component), FILES_AMONG), component, kinds)

    def find_component_usage(self, component: str, top_k: int = 20) -> DataFrame:
        """(path, component_name, snippet) of templates that name the component, in the order of five searches for it."""
        kebab = self.spark.range(1).select(pascal_to_kebab(F.lit(component))).first()[0]
        rows = hybrid_search(self.index, self._asked(component.lower(), kebab, *[t.format(kebab) for t in USAGE_TAGS]), top_k)
        return component_usage(rows, component, kebab, top_k)

    def stats(self) -> DataFrame:
        """One row: chunks indexed for words and vectors, the vectors' provider and size."""
        vectors = self.index.vectors.agg(F.count("*").alias("vectors"), F.max("provider").alias("provider"), F.max("dim").alias("dim"))
        return vectors.select(F.lit(self.index.lexical.chunks).alias("chunks"), F.lit(float(self.index.lexical.mean)).alias("mean_length"), F.lit(self.index.lexical.analyzer).alias("analyzer"), "vectors", "provider", "dim")


def counts_by_source(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_count)."""
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))


def with_counts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """sources(id, ...) with the number of their chunks, 0 where there are none."""
    rows = sources.join(counts_by_source(chunks).withColumnRenamed("source_id", "id"), "id", "left")
    return rows.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def contexts(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(source_id, path, anchor, content) for each of asked(source_id, path, anchor): the first chunk at the anchor, else all chunks of
    the file in corpus order with blank lines between, else a message."""
    asked = sized(asked.select("source_id", "path", "anchor").distinct())
    at = F.col("chunk_anchor").eqNullSafe(F.col("anchor")) & F.col("anchor").isNotNull()
    rows = chunks.select("source_id", "path", F.col("anchor").alias("chunk_anchor"), "seq", "id", "content").join(asked, ["source_id", "path"])
    rows = rows.groupBy("source_id", "path", "anchor").agg(F.min(F.when(at, F.struct("seq", "id", "content")))["content"].alias("one"), F.sort_array(F.collect_list(F.struct("seq", "id", "content"))).alias("all"))
    rows = rows.select("source_id", "path", F.col("anchor").alias("a"), F.coalesce("one", F.array_join(F.transform("all", lambda x: x["content"]), "\n\n")).alias("content"))
    out = asked.join(rows, (asked.source_id == rows.source_id) & (asked.path == rows.path) & asked.anchor.eqNullSafe(rows.a), "left").select(asked.source_id, asked.path, asked.anchor, "content")
    missing = F.concat(F.lit("No content found for "), "source_id", F.lit("/"), "path", F.when(F.col("anchor").isNotNull(), F.concat(F.lit("#"), "anchor")).otherwise(""))
    return out.withColumn("content", F.coalesce("content", missing))


def best_files(hits: DataFrame, component: Column | str, kinds: list[str]) -> DataFrame:
    """(file_type, path, content, class_name, selector, related_files): of ranked hits, the best of a component for each kind of file, whatever its case."""
    wanted = F.lit(component) if isinstance(component, str) else component
    rows = hits.where(F.lower("component_name") == F.lower(wanted)).where(F.col("file_type").isin(kinds))
    first = rows.groupBy("file_type").agg(F.min(F.struct("rank", "path", "content", "class_name", "selector", "related_files")).alias("r"))
    return first.select("file_type", "r.path", "r.content", "r.class_name", "r.selector", "r.related_files")


def source_filter(rows: DataFrame, language: str | None = None, file_type: str | None = None, component: str | None = None) -> DataFrame:
    rows = rows.where(F.col("kind").isin(*SOURCE_KINDS))
    for name, value in (("language", language), ("file_type", file_type), ("component_name", component)):
        rows = rows.where(F.col(name) == value) if value else rows
    return rows


def component_usage(rows: DataFrame, component: str, kebab: str, k: int) -> DataFrame:
    """Templates among hits (query_id, rank, ...) that have the component as a symbol or its name in their text, each path once."""
    named = F.exists("symbols_extracted", lambda s: F.lower(s["name"]) == component.lower())
    low = F.lower("content")
    hits = rows.where("file_type = 'template'").where(named | low.contains(component.lower()) | low.contains(kebab))
    hits = hits.groupBy("path").agg(F.min(F.struct("query_id", "rank", "component_name", "content")).alias("r"))
    return hits.select("path", "r.component_name", usage_snippet(F.col("r.content"), F.lit(component)).alias("snippet"), "r.query_id", "r.rank").orderBy("query_id", "rank").limit(k).drop("query_id", "rank")
