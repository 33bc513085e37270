"""The pruned search against all scores, and how much of the postings it reads."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docmill import queries
from docmill.functions.schema import as_chunks
from docmill.functions.text import query_terms
from docmill.operators import lexical, pruned

SF = "/root/testdata/sf0.1"


def rows_of(df):
    return sorted((r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 10, 5_000])
def test_pruned_search_gives_the_best_of_all(spark, k):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=int(2 ** rng.uniform(0, 9)))) for _ in range(400)] + ["", "w0 w0", "w0 w0"]
    chunks = as_chunks(spark.createDataFrame([(f"c{i}", "s", "p", "", t, i) for i, t in enumerate(texts)], "id string, source_id string, path string, title string, content string, seq long"))
    index = lexical.build_lexical(chunks, fields=("content",))
    asked = spark.createDataFrame([(1, "w0"), (2, "w1 w30 w1"), (3, "w50"), (4, "nothing"), (5, "w3 w7 w59 w2")], "query_id int, text string")
    terms = lexical.exploded(asked, F.split("text", " "))
    assert rows_of(pruned.pruned_search(pruned.tiered(index), terms, k)) == rows_of(lexical.top_k(lexical.bm25_scores(index, terms), k))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_share_of_the_postings_that_is_read(spark):
    index = lexical.build_lexical(queries.chunks_of(spark, SF))
    terms, told = lexical.exploded(queries.asked(spark), query_terms("text")), []
    t = pruned.tiered(index)
    assert rows_of(pruned.pruned_search(t, terms, 10, told)) == rows_of(lexical.top_k(lexical.bm25_scores(index, terms), 10))
    wanted = terms.distinct()
    every = index.postings.join(F.broadcast(wanted), "term").count()
    named = t.tiers.join(F.broadcast(told[1]), ["term", "tier"]).count()
    scored = index.postings.join(F.broadcast(wanted), "term").join(F.broadcast(told[0]), ["query_id", "id"], "left_semi").count()
    print("postings that name:", named, "that are scored:", scored, "of", every)
    assert named < 0.35 * every and scored < 0.5 * every
