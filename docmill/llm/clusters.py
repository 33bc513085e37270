"""Ball k-means over integer vectors: exact, with all but near centroids left out by their distance.

A cluster is a ball: its centroid and its radius, the distance of its farthest member. Centroids further from a ball's centre
than twice its radius can't take a member and are no neighbours of it. Members closer to the centre than half the way to the
nearest neighbour are the stable core and stay. The others lie in annuli, whose borders are half the ways to the neighbours in
order of distance: a member in the j-th annulus is compared with the first j neighbours only, exactly.

A round is one pass over the rows: each task measures its rows against their own centroid under the new centroids, then
against what the annuli leave, and writes the rows with their clusters and, beside them, what it has summed up for each
cluster. The sums, k rows a task, are added up by Spark. The radius that the neighbours go by is that of the round before plus
how far the centre has moved since, no less than the true one. All comparisons are of whole numbers, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.worker import released
from docmill.plans.shared import bounded_batches, local_table, release, shared_path, written

#: Components up to which squared distances are whole numbers in double precision, for up to 512 of them; beyond, Python's whole numbers are used.
EXACT = 1 << 20
#: The end of a long, and a squared radius that stands for any larger one: all centroids are neighbours then.
MOST, UNBOUNDED = (1 << 63) - 1, 1 << 120


def _numbers(rows: np.ndarray | list, big: bool) -> np.ndarray:
    """Vectors as doubles, or as Python's whole numbers where doubles wouldn't be exact."""
    return np.array(rows, object) if big else np.asarray(rows, np.float64)


def _is_big(x: np.ndarray) -> bool:
    return bool(x.size) and (x.shape[-1] > 512 or max(int(x.max()), -int(x.min())) > EXACT)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    if a.dtype == object:
        return np.array([[sum(d * d for d in p - q) for q in b] for p in a], object).reshape(len(a), len(b))
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


@dataclass
class Balls:
    """Centroids with, for each, its neighbours and how far they are, nearest first. None: nothing is known, all are compared."""

    centroids: list[list[int]]
    near: list[tuple[np.ndarray, list[int]]] | None = field(default=None)


def neighbours(old: Balls, new: list[list[int]], radius: list[int | None]) -> Balls:
    """The balls of centroids that moved from old to new. radius: squared, of the members around the old centroids; None for empty clusters."""
    both = np.array([old.centroids, new], np.int64)
    big = _is_big(both.reshape(-1, both.shape[-1]))
    c, before = _numbers(new, big), _numbers(old.centroids, big)
    near = []
    for i, r in enumerate(radius):
        if r is None:
            near.append((np.zeros(0, np.int64), []))
            continue
        apart = [int(d) for d in _apart(c[i : i + 1], c)[0]]
        moved = int(_apart(c[i : i + 1], before[i : i + 1])[0, 0])
        reach = 4 * (isqrt(r) + isqrt(moved) + 2) ** 2
        found = sorted((d, j) for j, d in enumerate(apart) if j != i and (d <= reach or r >= UNBOUNDED))
        near.append((np.array([j for _, j in found], np.int64), [d for d, _ in found]))
    return Balls(new, near)


def assign(balls: Balls, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances worked out) of rows x that were in the clusters own."""
    c = np.array(balls.centroids, np.int64)
    big = _is_big(x) or _is_big(c)
    x, c = _numbers(x, big), _numbers(c, big)
    if balls.near is None:
        d = _apart(x, c)
        best = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
        return best.astype(np.int32), d[np.arange(len(x)), best], d.size
    best, dist, n = own.astype(np.int64), np.zeros(len(x), object if big else np.float64), len(x)
    for i in np.unique(own):
        rows = np.flatnonzero(own == i)
        d = _apart(x[rows], c[i : i + 1])[:, 0]
        dist[rows] = d
        who, apart = balls.near[i]
        # The annulus of a row: how many neighbours are at most twice as far from the centre as the row is.
        ring = np.searchsorted(np.array(apart, object if big else np.float64), 4 * d, side="right") if apart else np.zeros(len(rows), np.int64)
        order = np.argsort(-ring, kind="stable")
        rows, ring = rows[order], ring[order]
        for k, j in enumerate(who):
            left = rows[: int(np.searchsorted(-ring, -k, side="left"))]  # those in annulus k + 1 and beyond
            if not len(left):
                break
            e = _apart(x[left], c[j : j + 1])[:, 0]
            n += len(left)
            nearer = (e < dist[left]) | ((e == dist[left]) & (j < best[left]))
            best[left[nearer]], dist[left[nearer]] = j, e[nearer]
    return best.astype(np.int32), dist, n


def _longs(values: np.ndarray) -> np.ndarray:
    """Whole numbers as longs; those beyond a long are the end of it."""
    return np.array([min(int(v), MOST) for v in values], np.int64) if values.dtype == object else values.astype(np.int64)


def _whole(values) -> pa.Array:
    """Whole numbers of any size as decimals."""
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _round(balls: Balls) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, x, cluster) with their next clusters, and at the task's end a row of sums for each cluster that it met."""
    k, width = len(balls.centroids), len(balls.centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far, inertia, compared = [0] * k, [0] * k, [0] * k, 0
        sums = np.zeros((k, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            cluster, dist, n = assign(balls, x, np.asarray(batch.column(2)))
            compared += n
            for i in np.unique(cluster):
                at = cluster == i
                part = x[at].astype(object) if _is_big(x) else x[at]
                sums[i] += part.sum(0)
                count[i] += int(at.sum())
                far[i] = min(UNBOUNDED, max(far[i], int(dist[at].max())))
                inertia[i] += sum(_longs(dist[at]).tolist())
            nothing = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(_longs(dist)), *(nothing.cast(t) for t in (pa.int64(), _DECIMAL, _DECIMAL, pa.list_(_DECIMAL), pa.int64()))], _NAMES)
        met = [i for i in range(k) if count[i]]
        if met:
            nothing = pa.nulls(len(met))
            flat = pa.ListArray.from_arrays(pa.array(range(0, width * len(met) + 1, width), pa.int32()), _whole(sums[met].ravel()))
            yield pa.RecordBatch.from_arrays([nothing.cast(pa.string()), nothing.cast(pa.list_(pa.int64())), pa.array(met, pa.int32()), nothing.cast(pa.int64()), pa.array([count[i] for i in met], pa.int64()), _whole(far[i] for i in met), _whole(inertia[i] for i in met), flat, pa.array([compared] + [0] * (len(met) - 1), pa.int64())], _NAMES)

    return run


_DECIMAL = pa.decimal128(38, 0)
_NAMES = ["row", "x", "cluster", "distance", "members", "far", "inertia", "sums", "compared"]
_KINDS = "row string, x array<long>, cluster int, distance long, members long, far decimal(38,0), inertia decimal(38,0), sums array<decimal(38,0)>, compared long"


def _advance(state: DataFrame, balls: Balls) -> tuple[DataFrame, DataFrame, str]:
    """The rows with their next clusters, and what tasks have summed up, each in a folder of its own."""
    spark, path = state.sparkSession, shared_path(state.sparkSession, "clusters")
    out = state.select("row", "x", "cluster").mapInArrow(released(_round(balls)), _KINDS)
    out.withColumn("kind", F.when(F.col("members").isNull(), "row").otherwise("sum")).write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(f"{_KINDS}, kind string").parquet(path)
    return rows.where("kind = 'row'").select("row", "x", "cluster", "distance"), rows.where("kind = 'sum'").drop("kind"), path


def _totals(sums: DataFrame, k: int, width: int) -> tuple[list[int], list[int | None], list[int], list[list[int]], int]:
    """(members, squared radius, inertia, sums of components) of each cluster, and distances worked out: k rows for each component."""
    parts = sums.select("cluster", "members", "far", "inertia", "compared", F.posexplode("sums").alias("place", "s"))
    found = parts.groupBy("cluster", "place").agg(F.sum("members").alias("n"), F.max("far").alias("far"), F.sum("inertia").alias("inertia"), F.sum("s").alias("s"), F.sum("compared").alias("compared")).collect()
    members, far, inertia, total, compared = [0] * k, [None] * k, [0] * k, [[0] * width for _ in range(k)], 0
    for r in found:
        i = r["cluster"]
        total[i][r["place"]] = int(r["s"])
        if r["place"] == 0:
            members[i], far[i], inertia[i] = r["n"], int(r["far"]), int(r["inertia"])
            compared += r["compared"]
    return members, far, inertia, total, compared


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(row, x): the id as text, and floor(scale * component), of the vectors with exactly width components, none null or non-finite."""
    kind = vectors.schema[vector_col].dataType.elementType
    v, inf = F.col(vector_col), F.lit(float("inf")).cast(kind)
    sound = v.isNotNull() & (F.size(v) == width) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (c != inf) & (c != -inf))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("string").alias("row"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def _seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k rows with the least hashes of seed and id; those that share an id go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("row", F.lit(""))), 256)
    return [list(r["x"]) for r in rows.orderBy(order, "x").limit(k).collect()]


@dataclass
class Clusters:
    """rows(row, x, cluster, distance); for each cluster centroid, members and inertia; rounds run and distances worked out in each."""

    rows: DataFrame | None
    centroids: list[list[int]]
    members: list[int]
    inertia: list[int]
    compared: list[int]


def ball_kmeans(rows: DataFrame, k: int, rounds: int, seed: int = 3) -> Clusters:
    """Clusters of rows(row, x), whose x are equally long arrays of longs.

    Each round assigns every row to the nearest centroid (ties: the smaller number) and replaces each centroid that has members
    by the floor of their mean; empty ones stay. At the end rows are assigned once more. Once no centroid moves, what is left of
    the rounds would change nothing and isn't run. The driver holds centroids, their neighbours and their sums, nothing of rows.
    """
    centroids = _seeds(rows, k, seed)
    if not centroids:
        return Clusters(None, [], [], [], [])
    balls, state, paths, compared = Balls(centroids), rows.withColumn("cluster", F.lit(-1)), [], []
    with bounded_batches(rows.sparkSession):
        for i in range(rounds + 1):
            state, sums, path = _advance(state, balls)
            members, far, inertia, total, n = _totals(sums, len(centroids), len(centroids[0]))
            compared.append(n)
            paths.append(path)
            if len(paths) > 1:
                release(_at(paths[-2]))
            moved = [[s // n for s in t] if n else c for c, t, n in zip(centroids, total, members, strict=True)]
            if i == rounds or moved == centroids:
                break
            balls, centroids = neighbours(balls, moved, far), moved
    return Clusters(state, centroids, members, inertia, compared)


class _at:  # noqa: N801
    """A written table known by its place."""

    def __init__(self, path: str):
        self._written_at = path


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector of exactly width components, none null or non-finite.

    Components are taken as floor(scale * x). Other vectors, empty and null ones among them, have no row; if none is left, or the
    table is empty, neither has the result. Rows that repeat, or share an id, count one by one; those with a null id hash as an
    empty one. With fewer vectors than k there are as many clusters. Components beyond a long are its ends; distances are
    compared exactly all the same; shown and summed up, those beyond a long are its end, and so are sums. Other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType
    rows = written(whole_vectors(vectors, id_col, vector_col, width, scale), "whole-vectors")
    found = ball_kmeans(rows, k, rounds, seed)
    of = [(i, min(x, MOST), min(sum(found.inertia), MOST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, (c, x) in enumerate(zip(found.centroids, found.inertia, strict=True))]
    told = local_table(vectors.sparkSession, of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    state = found.rows if found.rows is not None else rows.select("row", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    out = state.join(F.broadcast(told), "cluster")
    return out.select(F.col("row").cast(kind).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
