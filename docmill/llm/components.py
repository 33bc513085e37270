"""Connected components by alternating large-star and small-star (Kiveris et al., 2014) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.plans.shared import release, written


def _stars(edges: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """pairs(u, v) with v replaced by u's least neighbour or u itself, as (v, least).

    The least neighbours are an aggregation that combines before its shuffle, kept as a table,
    so that the join can split the rows of a hub.
    """
    least = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-least")
    out = written(pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
    release(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v) of longs; a component is named after its least node.

    Self loops, repeated and null edges are allowed and link nothing new. Each half round writes its edges, so
    work lost with an executor is redone from the last table only. The driver sees two numbers a round.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, both.where("v > u"), "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _stars(down, down.union(down.select("u", F.col("u").alias("v"))), "small-star")
        release(now, large)
        now, after = small, mark(small)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
