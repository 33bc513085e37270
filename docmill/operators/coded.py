"""Vectors as codes of four bits a component: a first pass over an eighth of the bytes, and exact scores of what it leaves.

A unit vector is rounded to fifteen steps of its largest component. A query is compared with the rounded vectors; what comes within
a slack of the k-th best, some standard deviations of what rounding does to a product, is looked up and compared exactly.
Codes and vectors are stored in ranges of ids, so that the second pass reads few of them. Scores are exact; a neighbour is missed
only if rounding has moved its product by more than the slack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.knn import batch_best, flat, rows_of_queries, unit
from docmill.operators.lexical import looked_up, top_k
from docmill.plans.shared import written

#: Standard deviations of the rounding of two products.
SLACK = 3.0


def codes_of(vectors: DataFrame) -> DataFrame:
    """(id, source_id, dim, code, error) of vectors(id, embedding[, source_id]); error: the length of what rounding took from the unit vector.

    Zero vectors have a code of zeros. Null vectors, and vectors with null or non-finite components, have a null code and are near nothing.
    """
    own = ["id", *(["source_id"] if "source_id" in vectors.columns else [])]
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(own))
            dims, codes, errors = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows, np.zeros(batch.num_rows, np.float32)
            sizes = np.array([len(v) if v.is_valid else -1 for v in column])
            for d in set(sizes[sizes > 0].tolist()):
                at = np.flatnonzero(sizes == d)
                x = flat(column.take(pa.array(at)))
                sound = np.isfinite(x).all(axis=1)
                x = unit(np.where(sound[:, None], x, 0))
                step = np.abs(x).max(axis=1, keepdims=True) / 7
                steps = np.rint(x / np.where(step > 0, step, 1))
                dims[at], errors[at] = d, np.sqrt(((x - steps * step) ** 2).sum(axis=1))
                nibbles = np.zeros((len(at), d + d % 2), np.uint8)
                nibbles[:, :d] = steps + 8
                packed = (nibbles[:, ::2] << 4) | nibbles[:, 1::2]
                for i, p, ok in zip(at.tolist(), packed, sound.tolist(), strict=True):
                    codes[i] = p.tobytes() if ok else None
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), pa.array(dims), pa.array(codes, pa.binary()), pa.array(errors)], [*own, "dim", "code", "error"])

    return vectors.select(*own, "embedding").mapInArrow(run, f"{kinds}, dim int, code binary, error float")


def save_codes(vectors: DataFrame, path: str) -> None:
    codes_of(vectors).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, dim, code[, source_id]) as (id, embedding[, source_id])."""
    for batch in batches:
        for d in set(batch.column(1).to_pylist()):
            part = batch.filter(pc.equal(batch.column(1), d))
            raw = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            x = np.stack((raw >> 4, raw & 15), axis=2).reshape(part.num_rows, -1)[:, :d].astype(np.float32) - 8
            rows = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * d, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), rows, *(part.column(i) for i in range(3, part.num_columns))], ["id", "embedding", *part.schema.names[3:]])


def nearest_coded(codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank), as nearest() gives it, for queries(query_id, embedding[, source]), of which the driver holds no more than it may.

    codes: of the vectors(id, embedding[, source_id]); codes of another dimension than the queries' are an error.
    """
    asked = rows_of_queries(queries, "source_id" in codes.columns)
    if asked is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double, rank int")
    known = codes.where(F.col("code").isNotNull())
    error = known.agg(F.max("error")).first()[0] or 0.0
    slack = SLACK * error / np.sqrt(asked.q.shape[1])
    kinds = f"query_id {asked.kind}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    best = batch_best(asked, k, slack)
    near = written(known.select("id", "dim", "code", *(["source_id"] if asked.sources is not None else [])).mapInArrow(lambda b: best(_decoded(b)), kinds), "near-codes")
    least = top_k(near, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    pairs = written(near.join(F.broadcast(least), "query_id", "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least") - slack)).select("query_id", "id"), "near-pairs")
    exact = looked_up(vectors.select("id", "embedding"), pairs).mapInArrow(batch_best(asked, None, 0.0, filtered=False), kinds)
    return top_k(exact.join(pairs, ["query_id", "id"], "left_semi"), k)
