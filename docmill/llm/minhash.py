"""MinHash near-duplicate detection (Broder 1997): universal hash minima, banding, exact confirmation, components.

Plan, for N documents:

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit digest of the shingle
   set and ``bands`` hashes of ``rows`` minima each. That table is written; it has some 200 bytes a document.
2. Documents with equal sets become one representative, the least id (combined before the shuffle).
3. Sets can only be similar if their sizes are, so a bucket's members are told apart by size class, the logarithm of the size to the
   base of the least ratio: links join sets of one class or of two neighbouring ones. Each member is paired with the least of its
   class and of the class below, if their sizes allow a link: at most 2 ``bands`` pairs a document, in practice few different ones.
   The pairs are confirmed on the full shingle sets, which are made again for the documents that are in a pair only.
4. Components of the confirmed pairs. Classes of a bucket, and neighbouring ones, that still hold several components are compared in
   blocks of about ``BLOCK`` members, so that no link between different sets is lost because the leader wasn't a copy.
   A large class is many blocks and so many tasks. Blocks return a spanning forest, never all pairs.
5. Components again, then every document takes the component of its set.

A pair at similarity s shares a bucket with probability 1 - (1 - s^rows)^bands; with 20 bands of 5, all but
8 in a million pairs at 0.85 do. Confirmation is exact up to 64-bit hash collisions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.worker import release_memory, released
from docmill.llm.components import connected_components
from docmill.llm.words import mix, shingle_set, word_hashes
from docmill.plans.shared import bounded_batches, release, sized, written

BLOCK = 256


def _coefficients(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the universal family x -> (a x + b) mod 2^32 with odd a, which is a permutation for each (a, b)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (a * x[None, i : i + 2048] + b).min(axis=1), out=out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _sketches(size: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows, seed)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, keys, sums = [], [], []
            for words in word_hashes(batch.column(1)):
                s = shingle_set(words, size)
                n.append(len(s))
                if len(s):
                    h = salt.copy()
                    for part in minima(s, a, b).reshape(bands, rows).T:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
                    keys.append(h)
                    sums.append((mix(s).sum(dtype=np.uint64), mix(~s).sum(dtype=np.uint64)))
                else:
                    keys.append(np.zeros(0, np.uint64))
                    sums.append((np.uint64(0), np.uint64(0)))
            sums = _signed(np.array(sums, np.uint64).reshape(-1, 2))
            at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = _signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "n_shingles", "d1", "d2", "keys"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_signed(shingle_set(w, size)) for w in word_hashes(batch.column(1))]
            d1 = _signed(np.array([mix(s.view(np.uint64)).sum(dtype=np.uint64) for s in sets], np.uint64))
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "d1", "s"])

    return run


def _block_links(percent: int):
    """Links of a spanning forest between the documents of one block, or of two."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "d1"], kind="stable").reset_index(drop=True)
        _, low, high, bi, bj = key
        sets = [np.asarray(s, np.int64) for s in rows["s"]]
        n = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), n)
        once = np.bincount(flat)[flat] > 1  # a shingle of one document adds to no intersection
        _, flat = np.unique(flat[once], return_inverse=True)
        doc = doc[once]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(flat, kind="stable")
        flat, doc = flat[order], doc[order]
        for lo in range(0, int(flat[-1]) + 1 if len(flat) else 0, 4096):
            i, j = np.searchsorted(flat, [lo, lo + 4096])
            has = np.zeros((len(sets), 4096), np.float32)
            has[doc[i:j], flat[i:j] - lo] = 1
            inter += has @ has.T
        inter = inter.astype(np.int64)
        hit = np.triu(100 * inter >= percent * (n[:, None] + n[None, :] - inter), 1)
        comp, part, ids = rows["component"].to_numpy(), rows["part"].to_numpy(), rows["id"].to_numpy()
        if low != high or bi != bj:
            hit &= part[:, None] != part[None, :]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for u, v in zip(*np.nonzero(hit & (comp[:, None] != comp[None, :])), strict=True):
            p, q = top(comp[u]), top(comp[v])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((ids[u], ids[v]))
        if len(sets) > BLOCK // 2:
            del inter, hit, sets, flat, doc
            release_memory()
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 80, bands: int = 20, rows: int = 5, seed: int = 7) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs, whose ids are longs.

    Words are maximal runs of other than ASCII white space, A-Z lower-cased. Rows whose sets of ``size``-word
    shingles have 100 * intersection >= percent * union are linked; component_id is the least id reachable, kept
    marks the row of that id. Null or blank texts have no shingles and link with nothing. An id that comes
    with several texts is linked by each of them, and each of its rows is returned. Rows with a null id link with
    nothing: component_id is null and kept true. Other columns are ignored, whatever their names.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    with bounded_batches(docs.sparkSession):
        out = written(_near(text, size, percent, bands, rows, seed, keep), "near-duplicates")
    release(*made)
    return out.withColumnRenamed("id", id_col)


def size_class(n: Column, percent: int) -> Column:
    """Sets of which the smaller has ``percent`` of the larger's size or more are in one class or in two neighbouring ones."""
    return F.floor(F.ln(n) / (math.log(100 / percent) * (1 + 1e-6))).cast("int") if percent < 100 else n.cast("int")


def _near(docs: DataFrame, size: int, percent: int, bands: int, rows: int, seed: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """near_duplicates() of docs(id, text); keep() writes a table that is read more than once."""
    sketches = keep(docs.mapInArrow(released(_sketches(size, bands, rows, seed)), "id long, n_shingles long, d1 long, d2 long, keys array<long>"), "sketches")
    full = sketches.where("n_shingles > 0 and id is not null")
    reps = keep(full.groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "representatives")
    # A node is (id, d1): an id can come with several texts.
    members = reps.select(F.struct("rep", "d1").alias("node"), F.col("n_shingles").alias("n"), size_class(F.col("n_shingles"), percent).alias("class"), F.explode("keys").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("members > 1")
    # Bands that bring the same members together are one bucket.
    buckets = keep(buckets.groupBy("members", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")
    in_buckets = keep(members.join(buckets, "bucket"), "in-buckets")
    leaders = keep(in_buckets.groupBy("bucket", "class").agg(F.min(F.struct("node", "n")).alias("leader"), F.count("*").alias("m")), "leaders")
    leader = leaders.select("bucket", "class", "leader").unionByName(leaders.select("bucket", (F.col("class") + 1).alias("class"), "leader"))
    pairs = in_buckets.join(leader, ["bucket", "class"]).where(F.col("node") != F.col("leader.node")).where(100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n"))
    pairs = keep(pairs.select(F.least("node", "leader.node").alias("node"), F.greatest("node", "leader.node").alias("leader")).distinct(), "pairs")
    ends = sized(pairs.select(F.col("node.rep").alias("id")).union(pairs.select("leader.rep")).distinct())
    sets = docs.join(ends, "id", "left_semi").mapInArrow(released(_sets(size)), "id long, d1 long, s array<long>").where("size(s) > 0").select(F.struct(F.col("id").alias("rep"), "d1").alias("node"), "s")
    repeated = keep(full.groupBy("id").agg(F.count("*").alias("n"), F.min("d1").alias("p"), F.max("d1").alias("q")).where("n > 1"), "repeated-ids")
    sets = keep(sets.dropDuplicates(["node"]) if repeated.take(1) else sets, "sets")
    inter = F.size(F.array_intersect("s", "t"))
    confirmed = pairs.join(sets, "node").join(sets.select(F.col("node").alias("leader"), F.col("s").alias("t")), "leader").where(100 * inter >= percent * (F.size("s") + F.size("t") - inter))
    same = full.join(sized(repeated.where("p <> q").select("id")), "id", "left_semi").join(reps, ["n_shingles", "d1", "d2"]).select(F.col("rep").alias("u"), F.col("id").alias("v")).distinct()
    links = keep(confirmed.select(F.col("node.rep").alias("u"), F.col("leader.rep").alias("v")).union(same), "links")
    component = keep(connected_components(links), "components")

    # Classes of a bucket, alone or with the one above, that still hold several components: compared block by block.
    placed = in_buckets.withColumn("rep", F.col("node.rep")).join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = keep(placed.groupBy("bucket", "class").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "held")
    above = held.select("bucket", (F.col("class") - 1).alias("class"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("blocks").alias("blocks2"))
    two = held.join(above, ["bucket", "class"]).where((F.least("p", "p2") < F.greatest("q", "q2")))
    group = lambda df, cls, part, blocks, others, step: df.select("bucket", F.expr(cls).cast("int").alias("class"), F.col("class").alias("low"), (F.col("class") + step).alias("high"), F.lit(part).alias("side"), F.col(blocks).alias("blocks"), F.col(others).alias("others"))
    open_ = group(held.where("p < q"), "class", 0, "blocks", "blocks", 0).union(group(two, "class", 1, "blocks", "blocks2", 1)).union(group(two, "class + 1", 2, "blocks2", "blocks", 1))
    rest = placed.select("node", "component", "bucket", "class").join(sized(keep(open_, "open")), ["bucket", "class"])
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    one = F.col("side") == 0
    first = F.when(one, F.least("block", "other")).when(F.col("side") == 1, F.col("block")).otherwise(F.col("other"))
    second = F.when(one, F.greatest("block", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("block"))
    rest = rest.select("node", "component", "bucket", "low", "high", first.alias("bi"), second.alias("bj"), F.when(one, F.col("block")).otherwise(F.col("side")).alias("part"))
    more = rest.join(sets, "node").select(F.col("node.rep").alias("id"), F.col("node.d1").alias("d1"), "component", "part", "s", "bucket", "low", "high", "bi", "bj")
    more = keep(more.groupBy("bucket", "low", "high", "bi", "bj").applyInPandas(_block_links(percent), "u long, v long"), "more-links")
    if more.take(1):
        component = keep(connected_components(links.union(more)), "components")
    found = keep(reps.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component")), "found")
    out = sketches.join(found, ["n_shingles", "d1", "d2"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
