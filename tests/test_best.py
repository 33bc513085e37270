"""The best chunks of many queries without a shuffle of their hits are those of all scores."""

import random

import numpy as np
import pyarrow as pa
import pytest

from docmill.operators import lexical


@pytest.mark.parametrize("at_once, scored", [(10_000, 256), (7, 3)])
def test_best_of_many_queries_against_all_scores(spark, monkeypatch, at_once, scored):
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "SCORED", scored)
    r = random.Random(5)
    word = lambda: f"w{min(r.randrange(40), r.randrange(40))}"
    texts = [" ".join(word() for _ in range(r.randrange(30))) for _ in range(120)] + ["w1 w2 w3"] * 40  # copies: equal scores go by id
    chunks = spark.createDataFrame([(i, "s", i, t) for i, t in enumerate(texts)], "id long, source_id string, seq long, content string").repartition(3)
    index = lexical.build_lexical(chunks, fields=("content",))
    terms = spark.createDataFrame([(q, word() if r.random() < 0.9 else "unknown") for q in range(30) for _ in range(4)], "query_id long, term string")
    rows = lambda df: sorted((x["query_id"], x["rank"], x["id"], round(x["score"], 6)) for x in df.collect())
    got = lexical.bm25_best(index, terms, 5)
    assert rows(got) == rows(lexical.top_k(lexical.bm25_scores(index, terms), 5))
    assert "times" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert lexical.bm25_best(index, terms.where("false"), 5).count() == 0


@pytest.mark.parametrize("pairs", [200_000, 50])
def test_few_hits_are_scored_and_the_best_are_exact(monkeypatch, pairs):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    r, k, n = np.random.default_rng(1), 3, 2000
    often = np.concatenate([np.full(4, 0.6), r.uniform(0.1, 0.4, 26), r.uniform(0.0005, 0.01, 70)])  # four are in most chunks and weigh next to nothing
    has = r.random((n, len(often))) < often
    adds = np.where(has, r.uniform(0.3, 2.2, has.shape).round(1), 0.0)
    adds[1000:1500] = adds[:500]  # copies: equal scores go by id
    weight = np.where(often > 0.5, 1e-6, np.log(1 / often))
    terms = [np.sort(r.choice(len(often), 4, replace=False)) for _ in range(60)] + [np.array([0, 1]), np.array([2])]
    no = np.concatenate(terms)
    wanted = pa.table({"query_id": np.repeat(np.arange(len(terms)), [len(t) for t in terms]), "weight": weight[no], "no": no, "most": adds.max(0)[no]})
    found = [np.flatnonzero(row) for row in adds]
    rows = pa.table({"id": np.arange(n), "seq": np.arange(n), "nos": pa.array([list(x) for x in found], pa.list_(pa.int64())), "adds": pa.array([list(row[x]) for row, x in zip(adds, found, strict=True)], pa.list_(pa.float64()))})
    told = []
    got = pa.Table.from_batches(list(lexical._best_of_chunks(wanted, k, told)(iter(rows.to_batches(300))))).to_pylist()
    rounded = lambda x: np.floor(x * 1e6 + 0.5)
    hits = 0
    for q, t in enumerate(terms):
        scores = (adds[:, t] * weight[t]).sum(1)
        hits += (scores > 0).sum()
        want = [i for i in np.lexsort((np.arange(n), -rounded(scores)))[:k] if scores[i] > 0]
        assert sorted((-rounded(x["score"]), x["id"]) for x in got if x["query_id"] == q) == [(-rounded(scores[i]), i) for i in want]
    assert 0 < sum(told) < hits  # terms looked up; hits have up to four each
