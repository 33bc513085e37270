"""The k best chunks by BM25 without scoring every posting: what can't lift a chunk among the best isn't read.

A term's postings are stored in tiers of what they add to a score, largest first, and for each tier the most that it adds is kept. The
tiers that add most name the first candidates; the k-th best of these, scored in full, is a threshold. Then each of a query's
terms gets a cut, the commonest first up to all that it can add, so that the cuts together stay below the threshold: a chunk with nothing
above its cuts can't be among the best. Only postings above the cuts name candidates, and only candidates' other postings are
looked up, in the index by terms and ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.lexical import Lexical, asked, bm25_weight, one_of, top_k
from docmill.plans.shared import few, held, sized, written

#: Tiers of an octave of what postings add.
PARTS = 8
#: Postings, for each of the k, of the tiers that name the first candidates.
AHEAD = 4
#: Scores are rounded to six places before they are ranked.
_MARGIN = 1e-5


@dataclass
class Tiered:
    """index; tiers(term, tier, id, ...), its postings by tier; bounds(term, tier, most, postings): the most that one adds at a weight of one."""

    index: Lexical
    tiers: DataFrame
    bounds: DataFrame


def tiered(index: Lexical, keep=written) -> Tiered:
    """The index with its postings in tiers, in ranges of terms and tiers, so that a scan for few of them skips the others."""
    adds = bm25_weight(index, weight=F.lit(1.0))
    rows = index.postings.select("term", F.floor(PARTS * F.log2(adds)).cast("int").alias("tier"), "id", adds.alias("adds"))
    rows = keep(rows.repartitionByRange("term", "tier").sortWithinPartitions("term", "tier", "id"), "tiers")
    bounds = rows.groupBy("term", "tier").agg(F.max("adds").alias("most"), F.count("*").alias("postings"))
    return Tiered(index, rows.drop("adds"), keep(bounds.repartitionByRange("term").sortWithinPartitions("term", "tier"), "bounds"))


def _named(t: Tiered, tiers: DataFrame, names: list[str] | None) -> DataFrame:
    """(query_id, id) of the postings in tiers(query_id, term, tier), each once."""
    rows = t.tiers if names is None else t.tiers.where(one_of("term", names))
    some = few(tiers.select("tier").distinct())
    rows = rows if some is None else rows.where(one_of("tier", sorted(r[0] for r in some)))
    return rows.join(sized(tiers), ["term", "tier"]).select("query_id", "id").distinct()


def _scored(t: Tiered, wanted: DataFrame, candidates: DataFrame, names: list[str] | None) -> DataFrame:
    """(query_id, id, seq, score) of candidates(query_id, id) in full."""
    rows = t.index.postings if names is None else t.index.postings.where(one_of("term", names))
    some = few(candidates.select("id").distinct())
    rows = rows if some is None else rows.where(one_of("id", sorted(r[0] for r in some)))
    hits = rows.join(wanted, "term").join(sized(candidates), ["query_id", "id"], "left_semi")
    return hits.groupBy("query_id", "id", "seq").agg(F.sum(bm25_weight(t.index)).alias("score"))


def _above_cuts(tiers: DataFrame, least: DataFrame) -> DataFrame:
    """Those of tiers(query_id, term, tier, top) that can lift a chunk to least(query_id, least): all where a query has no threshold."""
    most = tiers.groupBy("query_id", "term").agg(F.max("top").alias("m")).join(sized(least), "query_id", "left")
    spent = F.coalesce(F.sum("m").over(Window.partitionBy("query_id").orderBy("m", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cuts = most.withColumn("cut", F.when(F.col("least").isNull(), -1.0).otherwise(F.least("m", F.greatest(F.lit(0.0), F.col("least") - _MARGIN - spent)))).select("query_id", "term", "cut", "m")
    # A term that is cut up to all it adds names nobody; else a tier names if its most is above the cut.
    return tiers.join(cuts, ["query_id", "term"]).where((F.col("top") > F.col("cut")) & (F.col("cut") < F.col("m"))).select("query_id", "term", "tier")


def pruned_search(t: Tiered, terms: DataFrame, k: int, told: list | None = None) -> DataFrame:
    """(query_id, id, seq, score, rank): the k best chunks for terms(query_id, term), as top_k() gives them of all scores.

    Terms of several parts aren't looked for here. told gets the candidates, and the tiers that were read.
    """
    _, wanted = asked(t.index, terms, False)
    wanted = held(wanted)
    found = few(wanted.select("term").distinct())
    names = None if found is None else sorted(r[0] for r in found)
    bounds = t.bounds if names is None else t.bounds.where(one_of("term", names))
    tiers = bounds.join(wanted, "term").select("query_id", "term", "tier", (bm25_weight(t.index, adds=F.col("most"))).alias("top"), "postings")
    tiers = held(written(tiers, "asked-tiers"))
    order = Window.partitionBy("query_id").orderBy(F.desc("top"), "term", "tier").rowsBetween(Window.unboundedPreceding, -1)
    ahead = tiers.withColumn("before", F.coalesce(F.sum("postings").over(order), F.lit(0))).where(F.col("before") < AHEAD * k).select("query_id", "term", "tier")
    first = written(_named(t, ahead, names), "first-candidates")
    scores = written(_scored(t, wanted, first, names), "first-scores")
    least = top_k(scores, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    above = held(written(_above_cuts(tiers, least), "tiers-above"))
    rest = written(_named(t, above, names).join(sized(first), ["query_id", "id"], "left_anti"), "other-candidates")
    if told is not None:
        told += [first.unionByName(rest), ahead.unionByName(above).distinct()]
    return top_k(scores.unionByName(_scored(t, wanted, rest, names)), k)
