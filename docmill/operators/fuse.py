"""Weighted reciprocal rank fusion (Cormack, Clarke and Büttcher 2009)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, LEXICAL, VECTOR = 60, 0.4, 0.6


def fuse(lexical: DataFrame, vector: DataFrame, lexical_weight: float = LEXICAL, vector_weight: float = VECTOR, k: int = K) -> DataFrame:
    """(query_id, id, score, lexical_rank, vector_rank) from two tables (query_id, id, rank).

    An id that comes twice in a table has its worse rank there.
    """
    a = lexical.groupBy("query_id", "id").agg(F.max("rank").alias("lexical_rank"))
    b = vector.groupBy("query_id", "id").agg(F.max("rank").alias("vector_rank"))
    part = lambda w, rank: F.coalesce(F.lit(float(w)) / (k + F.col(rank)), F.lit(0.0))
    return a.join(b, ["query_id", "id"], "full_outer").withColumn("score", part(lexical_weight, "lexical_rank") + part(vector_weight, "vector_rank"))
