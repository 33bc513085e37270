"""Postings are counted for batches of chunks at once, as counting each chunk's tokens by itself gives them."""

import re
from collections import Counter

import pytest

from docmill.functions.porter import stem
from docmill.operators import lexical

TEXTS = ["b a b_a é A", "", None, "running runs run the", "x " * 20 + "the y", "  ", "the 1 of"]


@pytest.mark.parametrize("rows", [1, 3, 50_000])
@pytest.mark.parametrize("analyzer", ["plain", "porter"])
def test_postings_against_counts_of_each_chunk(spark, monkeypatch, rows, analyzer):
    monkeypatch.setattr(lexical, "ROWS", rows)
    chunks = spark.createDataFrame([(f"i{k}", "s", k, "T é", t) for k, t in enumerate(TEXTS)], "id string, source_id string, seq long, title string, content string").coalesce(1)
    known = (lambda t: t) if analyzer == "plain" else lambda t: stem(t.replace("é", "e"))
    words = lambda t: [known(w) for w in re.findall(r"[^\W_]+", (t or "").lower())]
    for positions in (False, True):
        index = lexical.build_lexical(chunks, analyzer, ("title", "content"), positions=positions)
        want = {}
        for k, t in enumerate(TEXTS):
            fields = [words("T é"), words(t)]
            places = [(w, i) for i, w in enumerate(fields[0])] + [(w, i + len(fields[0]) + 1) for i, w in enumerate(fields[1])]
            for w, tf in Counter(w for w, _ in places).items():
                want[f"i{k}", "s", k, len(places), w, tf] = [i for v, i in places if v == w]
        got = {(r["id"], r["source_id"], r["seq"], r["n"], r["term"], r["tf"]): r["at"] if positions else None for r in index.postings.collect()}
        assert got == (want if positions else dict.fromkeys(want))
        assert index.chunks == len(TEXTS) and index.mean == pytest.approx(sum(k[-1] for k in want) / len(TEXTS))


def test_tfidf_leaves_stopwords_out_and_no_token_is_sorted_one_by_one(spark):
    chunks = spark.createDataFrame([("i", "s", 1, "a", "the run of é é x yy")], "id string, source_id string, seq long, title string, content string")
    seen = []
    index = lexical.build_tfidf(chunks, lambda df, name: seen.append(df) or df)
    assert sorted((r["term"], r["tf"], r["n"]) for r in index.postings.collect()) == [("run", 1, 2), ("yy", 1, 2)]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "array_sort" not in plan and "MapInArrow" in plan
