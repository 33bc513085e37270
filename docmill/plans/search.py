"""Hybrid search: BM25 and vectors, fused, cut to k, boosted and shown with snippets. Any number of queries at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docmill.functions.text import query_terms, snippet, words
from docmill.functions.vocabulary import STOPWORDS
from docmill.operators import expand, fuse, knn, lexical
from docmill.plans.shared import few, held, local_table, sized, written


@dataclass
class HybridIndex:
    chunks: DataFrame
    lexical: lexical.Lexical
    vectors: DataFrame  # id, source_id, embedding, provider, dim
    provider: knn.Provider
    expansions: DataFrame | None = None
    made_by: tuple[str, int | None] | None = None  # name and dimension of the provider that made all vectors, if that is known


def made_by(provider: knn.Provider) -> tuple[str, int | None]:
    return getattr(provider, "name", "custom"), getattr(provider, "dim", None)


def build_hybrid(chunks: DataFrame, provider: knn.Provider | None = None, analyzer: str = "porter", expansions: DataFrame | None = None, keep=written, stored: bool = False) -> HybridIndex:
    """An index of chunks; of chunks with one id the last counts. stored: see lexical.build_lexical()."""
    provider = provider or knn.hashing_provider()
    chunks = keep(lexical.latest(chunks), "latest-chunks")
    vectors = knn.embed_chunks(chunks, provider)
    return HybridIndex(chunks, lexical.build_lexical(chunks, analyzer, keep=keep, positions=True, stored=stored), keep(vectors, "vectors"), provider, expansions, made_by(provider))


def search_terms(queries: DataFrame, expansions: DataFrame | None) -> DataFrame:
    """(query_id, term[, source]) for BM25: expanded words without marks and stopwords, of any length; else the words."""
    if expansions is None:
        return lexical.exploded(queries, query_terms("text"))
    return unmarked(expand.expanded_terms(queries, expansions)).distinct()


def unmarked(terms: DataFrame) -> DataFrame:
    """Terms as the lexical index has them; stopwords and what is nothing but marks are left out."""
    rows = terms.withColumn("term", F.regexp_replace("term", r"(?U)[^\w]", ""))
    return rows.where((F.col("term") != "") & ~F.col("term").isin(sorted(STOPWORDS)))


def shown_terms(queries: DataFrame, expansions: DataFrame | None) -> DataFrame:
    """(query_id, asked): the terms that boosts and snippets look for."""
    if expansions is None:
        return queries.select("query_id", F.array_distinct(words("text")).alias("asked"))
    return expand.expanded_terms(queries, expansions).groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("asked"))


def both_terms(queries: DataFrame, expansions: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """search_terms() and shown_terms(); those of a few queries are expanded where the plan is made, without a job."""
    rows = few(queries) if expansions is not None else None
    if rows is None:
        return search_terms(queries, expansions), sized(shown_terms(queries, expansions))
    spark, extra = queries.sparkSession, [c for c in ("source",) if c in queries.columns]
    own = local_table(spark, rows, queries.schema).select("query_id", words("text"), *extra).collect()
    found = expand.expanded_few(own, expansions)
    kind = StructType([queries.schema["query_id"], StructField("term", StringType()), *[queries.schema[c] for c in extra]])
    terms = unmarked(local_table(spark, found, kind)).collect()
    asked: dict = {}
    for query, term, *_ in found:
        asked.setdefault(query, set()).add(term)
    shown = local_table(spark, [(q, sorted(ts)) for q, ts in asked.items()], StructType([queries.schema["query_id"], StructField("asked", ArrayType(StringType()))]))
    return local_table(spark, list(dict.fromkeys(terms)), kind), F.broadcast(shown)


def rank_hybrid(queries: DataFrame, chunks: DataFrame, lexical_hits: DataFrame, vector_hits: DataFrame, asked: DataFrame, k: int, entry: float = 1.3, title: float = 0.2) -> DataFrame:
    """Fused hits, cut to k before the boosts, which so only reorder them; hits that aren't chunks leave a gap."""
    fused = held(lexical.top_k(fuse.fuse(lexical_hits, vector_hits), k, places=12).drop("rank"))
    rows = lexical.looked_up(chunks, fused).join(fused, "id").join(asked, "query_id")
    overlap = F.size(F.array_intersect(words("title"), "asked"))
    rows = rows.withColumn("score", F.col("score") * F.when(F.col("is_entrypoint"), F.lit(entry)).otherwise(1.0) * (1 + title * overlap))
    rows = lexical.top_k(rows, k, places=12)
    return rows.withColumn("snippet", snippet(F.col("content"), F.col("asked"))).drop("asked")


def nearest_texts(index: HybridIndex, queries: DataFrame, k: int) -> DataFrame:
    """The k vectors closest to each of queries(query_id, text[, source]); the texts of a few queries are embedded where the plan is made."""
    rows = few(queries)
    if rows is None or not rows:
        return knn.nearest(index.vectors, knn.embed(queries, F.col("text"), index.provider), k)
    kind = queries.schema["query_id"].dataType
    found = np.array(knn.embed_texts(index.provider, [r["text"] for r in rows]), float)
    return knn.nearest_to(index.vectors, pa.array([r["query_id"] for r in rows], to_arrow_type(kind)), found, [r["source"] for r in rows] if "source" in queries.columns else None, k, kind.simpleString())


def hybrid_search(index: HybridIndex, queries: DataFrame, k: int = 8, fetch: int = 3) -> DataFrame:
    """The k best chunks of each of queries(query_id, text[, source]); blank queries have none.

    Vectors are searched with the query as it was written; the index's provider makes both sides' vectors.
    """
    queries = held(queries.where(~F.col("text").rlike(r"(?U)\A\s*\z")))
    name, dim = made_by(index.provider)
    if index.made_by is None:
        odd = index.vectors.where((F.col("provider") != name) | (F.col("dim") != (F.lit(dim) if dim else F.col("dim")))).limit(1).take(1)
    else:
        odd = index.made_by[0] != name or None not in (dim, index.made_by[1]) and dim != index.made_by[1]
    if odd:
        raise ValueError(f"the vectors were not made by {name}")
    terms, asked = both_terms(queries, index.expansions)
    lexical_hits = lexical.top_k(lexical.bm25_scores(index.lexical, terms, "source" in queries.columns), fetch * k)
    return rank_hybrid(queries, index.chunks, lexical_hits, nearest_texts(index, queries, fetch * k), asked, k)
