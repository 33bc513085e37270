"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are first reduced to (id, pattern, size, order); a pattern is the set of sources that hold a document.
Words are routed from patterns to source quotas by a min-cost flow in which the k-th use of a pattern's words costs
more than the one before: on the driver, or, if patterns are many, in one task for each set of sources that patterns connect. Every
pattern's flow is a number of whole uses of all its documents and a rest; the rest goes to the first documents in a seeded order.
Where that order is cut is found by counts over 4096 cells, again in the cell that holds the cut, until a running sum over
that cell is a small task; so no pattern, however large, is sorted in one task, nor are rows of one id, or equal ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.components import connected_components
from docmill.plans.shared import few, sized, written

WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float], most: int) -> dict[str | None, float]:
    """Each source's share of all sizes, by weights repeated over the sources in code point order, null last.

    No target is above most * its source's size; what is above is shared again by weight among the others.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    full: dict[str | None, float] = {}
    rest, total = dict(w), float(sum(sizes.values()))
    while rest:
        share = (total - sum(full.values())) / sum(rest.values())
        over = [s for s in rest if share * rest[s] > most * sizes[s]]
        if not over:
            return full | {s: share * x for s, x in rest.items()}
        for s in over:
            full[s] = float(most * sizes[s])
            del rest[s]
    return full


def min_cost_flow(supply: list[int], arcs: list[tuple[int, int]], quota: list[int], costs: Sequence[float]) -> list[dict[int, int]]:
    """Words that each pattern sends to each source: most words first, then least repetition.

    supply: words of each pattern, which can be used len(costs) times, the k-th time at costs[k] (rising) a word.
    arcs: (pattern, source). Only the way into a pattern costs anything, and no shortest path leaves it again, so that shortest
    augmenting paths are those of the cheapest use that still has a way to a quota: a maximal flow with one use of each pattern,
    enlarged with two, and so on. Each is found in phases of blocking flows (Dinic 1970), of which there are no more than sources.
    """
    n_p, n_s = len(supply), len(quota)
    begin, end = n_p + n_s, n_p + n_s + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]

    def arc(u: int, v: int, c: int) -> None:
        for a, b, k in ((u, v, c), (v, u, 0)):
            out[a].append(len(to))
            to.append(b)
            cap.append(k)

    for p in range(n_p):
        arc(begin, p, 0)
    links = len(to)
    for p, s in arcs:
        arc(p, n_p + s, supply[p] * len(costs))
    for s, q in enumerate(quota):
        arc(n_p + s, end, q)
    for _ in sorted(costs):
        for p, size in enumerate(supply):
            cap[2 * p] += size
        while True:
            depth = [-1] * len(out)
            depth[begin] = 0
            queue = [begin]
            for u in queue:
                for e in out[u]:
                    if cap[e] and depth[to[e]] < 0:
                        depth[to[e]] = depth[u] + 1
                        queue.append(to[e])
            if depth[end] < 0:
                break
            due = [0] * len(out)
            path: list[int] = []
            u = begin
            while True:
                if u == end:
                    step = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= step
                        cap[e ^ 1] += step
                    k = next(i for i, e in enumerate(path) if not cap[e])
                    u = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while due[u] < len(out[u]) and not (cap[e := out[u][due[u]]] and depth[to[e]] == depth[u] + 1):
                    due[u] += 1
                if due[u] < len(out[u]):
                    path.append(out[u][due[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    due[u] += 1
                else:
                    break
    sent: list[dict[int, int]] = [{} for _ in supply]
    for i, (p, s) in enumerate(arcs):
        if cap[links + 2 * i + 1]:
            sent[p][s] = cap[links + 2 * i + 1]
    return sent


def route(supply: list[int], arcs: list[tuple[int, int]], quota: list[int], costs: Sequence[float]) -> list[dict[int, int]]:
    """min_cost_flow() of each set of sources that patterns connect, which is a small problem where few sources overlap."""
    root = list(range(len(quota)))

    def top(s: int) -> int:
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    of: list[list[int]] = [[] for _ in supply]
    for p, s in arcs:
        of[p].append(s)
    for ss in of:
        for s in ss[1:]:
            root[top(ss[0])] = top(s)
    parts: dict[int, tuple[list[int], list[int]]] = {}
    for s in range(len(quota)):
        parts.setdefault(top(s), ([], []))[1].append(s)
    for p, ss in enumerate(of):
        if ss:
            parts[top(ss[0])][0].append(p)
    sent: list[dict[int, int]] = [{} for _ in supply]
    for ps, ss in parts.values():
        at = {s: i for i, s in enumerate(ss)}
        for p, flow in zip(ps, min_cost_flow([supply[p] for p in ps], [(i, at[s]) for i, p in enumerate(ps) for s in of[p]], [quota[s] for s in ss], costs), strict=True):
            sent[p] = {ss[i]: w for i, w in flow.items()}
    return sent


#: Patterns that the driver may hold, and rows of a cell that one task may sort.
DRIVER_PATTERNS, CELL_ROWS = 100_000, 1_000_000
_PLAN = "pattern string, source_size long, target double, uses long, rest long"


def _planned(found: list[tuple[str, list[str | None], int]], sizes: dict[str | None, int], goal: dict[str | None, float], costs: Sequence[float]) -> list[tuple]:
    """The rows of _PLAN for patterns (pattern, sources, size)."""
    names = list(dict.fromkeys(s for _, ss, _ in found for s in ss))
    at = {s: i for i, s in enumerate(names)}
    sent = route([size for _, _, size in found], [(p, at[s]) for p, (_, ss, _) in enumerate(found) for s in ss], [round(goal[s]) for s in names], costs)
    out = []
    for (pattern, ss, size), flow in zip(found, sent, strict=True):
        words = sum(flow.values())
        out.append((pattern, sum(sizes[s] for s in ss), float(sum(goal[s] for s in ss)), words // size if size else 0, words % size if size else 0))
    return out


def plan(patterns: DataFrame, weights: Sequence[float], most: int, costs: Sequence[float], driver_patterns: int = DRIVER_PATTERNS) -> DataFrame:
    """_PLAN for patterns(pattern, size), pattern being the JSON list of its sources.

    More than driver_patterns are solved by connected sources, each set in a task, to which a set's patterns go. The driver holds a row a
    source.
    """
    spark = patterns.sparkSession
    rows = few(patterns.select("pattern", "size"), driver_patterns)
    if rows is not None:
        found = sorted((r["pattern"], json.loads(r["pattern"]), int(r["size"])) for r in rows)
        sizes: dict[str | None, int] = {}
        for _, names, size in found:
            for s in names:
                sizes[s] = sizes.get(s, 0) + size
        return spark.createDataFrame(_planned(found, sizes, targets(sizes, weights, most), costs), _PLAN)
    listed = patterns.withColumn("names", F.from_json("pattern", "array<string>"))
    counted = listed.select(F.explode("names").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("size")).collect()
    sizes = {r["s"]: int(r["size"]) for r in counted}
    goal = targets(sizes, weights, most)
    number = sized(spark.createDataFrame([(s, i) for i, s in enumerate(goal)], "s string, i long"))
    ids = listed.select("pattern", "size", F.explode("names").alias("n")).join(number, F.col("n").eqNullSafe(F.col("s"))).groupBy("pattern", "size").agg(F.min("i").alias("first"), F.collect_list("i").alias("ids"))
    ids = written(ids, "patterns")
    parts = written(connected_components(ids.select(F.col("first").alias("u"), F.explode("ids").alias("v"))), "connected-sources")

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        found = sorted((p, json.loads(p), int(n)) for p, n in zip(part["pattern"], part["size"], strict=True))
        return pd.DataFrame(_planned(found, sizes, goal, costs), columns=["pattern", "source_size", "target", "uses", "rest"])

    ids = ids.join(parts.withColumnRenamed("node", "first"), "first", "left").select("pattern", "size", F.coalesce("component", "first").alias("set"))
    return written(ids.groupBy("set").applyInPandas(solved, _PLAN), "plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = (5, 2, 1), most: int = 3, costs: Sequence[float] = (0, 1, 3), seed: str = "mix", driver_patterns: int = DRIVER_PATTERNS, carry: Sequence[str] = ()) -> DataFrame:
    """(id_col, version, size, source_size, target, taken[, carried]) for every row of docs: the words the mix takes of it, repeats counted.

    source_col is a string, or an array of strings for documents that several sources hold. A null or empty array is
    the null source. Sizes are word counts; null texts have size 0. target is the sum of targets of the document's
    sources and source_size that of their sizes. taken is a whole multiple, ``most`` at most, of size; a source's
    taken words differ from its quota by half a document at most for each of its patterns. Rows that share an
    id, or have none, are separate; equal rows are interchangeable. version is a hash of the text. carried is a struct of the columns
    named in ``carry``, of the same row. Other columns are ignored.
    """
    if len(costs) != most:
        raise ValueError("costs must hold a cost for each of the uses allowed")
    source = F.col(source_col)
    if docs.schema[source_col].dataType.typeName() == "array":
        members = F.when(F.size(source) > 0, F.array_sort(F.array_distinct(source.cast("array<string>")))).otherwise(F.array(F.lit(None).cast("string")))
    else:
        members = F.array(source.cast("string"))
    text = F.col(text_col).cast("string")
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.to_json(members).alias("pattern"), text_size(text).alias("size"), order.alias("order"), *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []))
    # Rows that the order doesn't tell apart go by what they hold, and equal ones by a number, which the written table fixes.
    rows = written(rows.withColumn("more_order", F.xxhash64("id", "version", "size")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    planned = sized(plan(rows.groupBy("pattern").agg(F.sum("size").alias("size")), weights, most, costs, driver_patterns))
    bits = lambda c, n: F.shiftrightunsigned(c, n).bitwiseAND(4095)
    cells = [*[bits("order", n) for n in (36, 24, 12, 0)], *[bits("more_order", n) for n in (52, 40, 28, 16, 4)], *[bits("row", n) for n in (52, 40, 28, 16, 4)]]
    cuts = planned.where("rest > 0").select("pattern", "rest", F.array().cast("array<bigint>").alias("cut"), F.lit(0).cast("long").alias("before"))
    for depth, cell in enumerate(cells):
        here = rows.join(cuts, "pattern").where(F.array(*cells[:depth]) == F.col("cut")) if depth else rows.join(cuts, "pattern")
        found = here.groupBy("pattern", "rest", "cut", "before", cell.alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("cell"))
        found = found.withColumn("upto", upto).where("upto - words < rest and rest <= upto")
        found = written(found.select("pattern", "rest", F.concat("cut", F.array("cell")).alias("cut"), (F.col("upto") - F.col("words")).alias("before"), "n"), "cuts")
        cuts = sized(found.drop("n"))
        if (found.agg(F.max("n")).first()[0] or 0) <= CELL_ROWS:
            break
    at = F.array(*cells[: depth + 1])
    rows = rows.join(planned, "pattern").join(cuts.drop("rest"), "pattern", "left")
    run = F.sum("size").over(Window.partitionBy("pattern").orderBy("order", "more_order", "row").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = rows.where(at == F.col("cut")).withColumn("upto", F.col("before") + run)
    at_edge = at_edge.withColumn("more", (2 * F.col("upto") - F.col("size") <= 2 * F.col("rest")).cast("long"))
    away = rows.where(~F.coalesce(at == F.col("cut"), F.lit(False))).withColumn("more", F.coalesce(at < F.col("cut"), F.lit(False)).cast("long"))
    keep = ["id", "version", "size", "source_size", "target", "uses", "more", *(["carried"] if carry else [])]
    out = away.select(keep).unionByName(at_edge.select(keep))
    taken = F.col("size") * F.least(F.lit(most), F.col("uses") + F.col("more"))
    return out.select(F.col("id").alias(id_col), "version", "size", "source_size", "target", taken.alias("taken"), *keep[7:])
