"""Nearest neighbours by cosine: exact, or by random projections; and embedding providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docmill.operators.lexical import top_k
from docmill.plans.shared import few, sized, written


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def flat(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, in double precision. Null vectors are zero vectors."""
    n = len(column)
    if column.null_count:
        width = max((len(v) for v in column if v.is_valid), default=0)
        column = pa.array([v.as_py() if v.is_valid else [0.0] * width for v in column], column.type)
    flat = np.asarray(column.flatten(), float)
    if n and len(flat) % n or (np.diff(np.asarray(column.offsets)) != len(flat) // max(1, n)).any():
        raise ValueError("vectors of several dimensions")
    return flat.reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero vectors stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(size > 0, x, 0) / np.where(size > 0, size, 1)


@dataclass
class Asked:
    """Queries that the driver holds: ids, unit vectors, and for each the code of its source (-1: any) if sources are asked for."""

    ids: pa.Array
    q: np.ndarray
    sources: np.ndarray | None
    codes: dict[str, int]
    kind: str


def asked_vectors(query_ids: pa.Array, q: np.ndarray, sources: list | None, kind: str) -> Asked:
    q = np.asarray(q, float).reshape(len(query_ids), -1)
    q = q / np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)
    codes = {s: i for i, s in enumerate(dict.fromkeys(s for s in sources or [] if s is not None))}
    return Asked(query_ids, q, None if sources is None else np.array([-1 if s is None else codes[s] for s in sources]), codes, kind)


def rows_of_queries(queries: DataFrame, filtered: bool, most: int | None = None) -> Asked | None:
    """queries(query_id, embedding[, source]) on the driver; None if there are none, an error if there are too many."""
    rows = few(queries, most or MOST_QUERIES)
    if rows is None:
        raise ValueError(f"more than {most or MOST_QUERIES} queries at once")
    kind = queries.schema["query_id"].dataType
    sources = [r["source"] for r in rows] if filtered and "source" in queries.columns else None
    return asked_vectors(pa.array([r["query_id"] for r in rows], to_arrow_type(kind)), np.array([r["embedding"] for r in rows], float), sources, kind.simpleString()) if rows else None


def batch_best(asked: Asked, k: int | None, slack: float = 0.0, filtered: bool = True):
    """A mapInArrow function from batches (id, embedding[, source_id]) to the k best rows of each batch for each query, those that come within slack of the k-th too; without k to all rows."""
    q, sources = asked.q, asked.sources if filtered else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = flat(batch.column(1))
            if x.shape[1] != q.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} dimensions, queries of {q.shape[1]}")
            x = unit(x)
            own = np.array([asked.codes.get(v, -2) for v in batch.column(2).to_pylist()]) if sources is not None else None
            for j in range(0, len(q), QUERIES_AT_ONCE):
                s = np.round(x @ q[j : j + QUERIES_AT_ONCE].T, 6) + 0.0
                if own is not None:
                    wanted = sources[j : j + QUERIES_AT_ONCE]
                    s[(wanted[None, :] != -1) & (wanted[None, :] != own[:, None])] = -np.inf
                least = np.partition(s, len(s) - k, axis=0)[len(s) - k] - slack if k is not None and len(s) > k else np.full(s.shape[1], -np.inf)
                row, query = np.nonzero((s >= least) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query + j)), batch.column(0).take(pa.array(row)), pa.array(s[row, query])], ["query_id", "id", "score"])

    return run


#: Queries that are compared with a batch at once, and that go to every task at once.
QUERIES_AT_ONCE, MOST_QUERIES = 256, 10_000


def nearest_to(vectors: DataFrame, query_ids: pa.Array, q: np.ndarray, sources: list | None, k: int, query_type: str) -> DataFrame:
    """(query_id, id, score, rank): the k vectors closest to each row of q, of a few queries that the driver holds."""
    filtered = sources is not None and "source_id" in vectors.columns
    asked = asked_vectors(query_ids, q, sources if filtered else None, query_type)
    kinds = f"query_id {query_type}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    return top_k(vectors.select("id", "embedding", *(["source_id"] if filtered else [])).mapInArrow(batch_best(asked, k), kinds), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = MOST_QUERIES) -> DataFrame:
    """(query_id, id, score, rank): the k vectors closest to each query vector, which may be any number.

    vectors: (id, embedding[, source_id]); queries: (query_id, embedding[, source]). At most about most_queries go to every
    task at once; more are dealt by their ids into several passes over the vectors. Each batch of vectors gives its
    k best for each query by one matrix product, and only these are ranked.
    """
    kind, arrow = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
    rows = few(queries, most_queries)
    parts = [rows] if rows is not None else []
    if rows is None:
        passes = -(-queries.count() // most_queries)
        parts = (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).collect() for i in range(passes))
    found = []
    for part in parts:
        if part:
            best = nearest_to(vectors, pa.array([r["query_id"] for r in part], arrow), np.array([r["embedding"] for r in part], float), [r["source"] for r in part] if "source" in queries.columns else None, k, kind)
            found.append(best if rows is not None else written(best, "nearest"))
    if not found:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, id {vectors.schema['id'].dataType.simpleString()}, score double, rank int")
    return reduce(DataFrame.unionByName, found)


def lsh_nearest(vectors: DataFrame, queries: DataFrame, k: int, planes: int = 8, tables: int = 32, probes: int = 8, seed: int = 3) -> DataFrame:
    """Like nearest(), but only vectors that share a bucket of signs of random projections (Charikar 2002) with the query are compared.

    In each table the query looks into its own bucket and into those that are reached by crossing the planes it is nearest
    to (multiprobe, Lv et al. 2007), probes in all. Buckets join on their keys, ids only, so that neither side is sent to
    every task unless the queries are few. On vectors without near neighbours most of the table is compared.
    """

    def keyed(df: DataFrame, id_col: str, probes: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            flips = np.arange(1 << planes)
            crossed = (flips[:, None] >> np.arange(planes)) & 1
            for b in batches:
                if len(b):
                    x = np.array(b["embedding"].tolist(), float)
                    at = (x @ np.random.default_rng(seed).normal(size=(x.shape[1], planes * tables))).reshape(len(x), tables, planes)
                    own = ((at > 0) * (1 << np.arange(planes))).sum(axis=2)[:, :, None]
                    if probes > 1:  # the masks of planes of least squared distance to cross
                        own = own ^ np.argsort(at**2 @ crossed.T, axis=2, kind="stable")[:, :, :probes]
                    b["bucket"] = list((own + (np.arange(tables) << planes)[:, None]).reshape(len(x), -1))
                    yield b[[id_col, "bucket"]]

        return df.select(id_col, "embedding").mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, bucket array<long>").withColumn("bucket", F.explode("bucket"))

    pairs = keyed(vectors, "id", 1).join(sized(keyed(queries, "query_id", min(probes, 1 << planes))), "bucket").select("query_id", "id").distinct()
    pairs = pairs.join(vectors.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return top_k(pairs.select("query_id", "id", cosine(F.col("q"), F.col("embedding")).alias("score")), k)


Provider = Callable[[list[str]], "np.ndarray"]


def hashing_provider(dim: int = 384) -> Provider:
    """Unit vectors of signed hashed words (Weinberger et al. 2009); needs no model and always gives the same."""
    import re
    import zlib

    word = re.compile(r"\w+")

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in word.findall(t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)

    embed.name, embed.dim = f"hashing-{dim}", dim
    return embed


def embedding_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def embed_texts(provider: Provider, texts: list[str | None], batch: int = 100) -> list[np.ndarray]:
    """The provider's vectors of texts, asked for in batches; a blank text is sent as one space."""
    texts = [t if t and t.strip() else " " for t in texts]
    return [v for i in range(0, len(texts), batch) for v in np.asarray(provider(texts[i : i + batch]), np.float32)]


def embed(df: DataFrame, text: Column, provider: Provider, batch: int = 100, drop: tuple[str, ...] = ()) -> DataFrame:
    """df, less the columns to drop, with embedding, provider and dim; the provider gets batches of texts, a blank text as one space."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = embed_texts(provider, list(b.pop("_text")), batch)
            yield b.assign(embedding=found, provider=getattr(provider, "name", "custom"), dim=[len(v) for v in found])

    return df.withColumn("_text", text).drop(*drop).mapInPandas(run, f"{kind}, embedding array<float>, provider string, dim int")


def embed_chunks(chunks: DataFrame, provider: Provider, known: DataFrame | None = None) -> DataFrame:
    """(id, source_id, embedding, provider, dim, digest) of chunks(id, source_id, title, content).

    known: vectors in these columns, of which those that the same provider made of the same text are taken over; the provider gets the
    other texts only.
    """
    text = embedding_text(F.col("title"), F.col("content"))
    rows = chunks.select("id", "source_id", F.sha2(text, 256).alias("digest"), text.alias("_t"))
    new = lambda df: embed(df, F.col("_t"), provider, drop=("_t",))
    columns = ["id", "source_id", "embedding", "provider", "dim", "digest"]
    if known is None:
        return new(rows).select(columns)
    dim = getattr(provider, "dim", None)
    own = known.where((F.col("provider") == getattr(provider, "name", "custom")) & F.col("digest").isNotNull() & (F.lit(True) if dim is None else F.col("dim") == dim))
    own = own.join(sized(rows.select("digest").distinct()), "digest", "left_semi").groupBy("digest").agg(F.any_value("embedding").alias("embedding"), F.any_value("provider").alias("provider"), F.any_value("dim").alias("dim"))
    own = sized(written(own, "known-vectors"))
    return rows.join(own, "digest").select(columns).unionByName(new(rows.join(own.select("digest"), "digest", "left_anti")).select(columns))
