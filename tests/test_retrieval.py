import math
import sqlite3

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.functions.schema import as_chunks
from docmill.operators import expand, fuse, knn, lexical
from docmill.plans.search import build_hybrid, hybrid_search
from docmill.sources import store

CHUNKS = [
    ("c1", "test", "docs/button.md", "Button", "A button runs an action. Buttons can be primary or secondary.", True, 1),
    ("c2", "test", "docs/button-api.md", "Button props", "The disabled prop turns the button off; café running", False, 2),
    ("c3", "test", "docs/modal.md", "Modal dialog", "A modal shows a dialog over the page. It can hold a button.", True, 3),
    ("c4", "other", "docs/input.md", "Input", "Text input with validation and an error message", False, 4),
    ("c5", "other", "docs/empty.md", "", "", False, 5),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return as_chunks(spark.createDataFrame(CHUNKS, "id string, source_id string, path string, title string, content string, is_entrypoint boolean, seq long")).cache()


def asked(spark, *texts, source=False):
    return spark.createDataFrame([(i, *(t if source else (t,))) for i, t in enumerate(texts)], "query_id int, text string" + (", source string" if source else ""))


def fts(query, where=""):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id, source_id, path, title, content, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?, ?, ?, ?)", [(c[0], c[1], c[2], c[3].lower(), c[4].lower()) for c in CHUNKS])
    return {r[0]: -r[1] for r in db.execute(f"select id, bm25(t) from t where t match ? {where}", (query,))}


@pytest.mark.parametrize("query", ["button", "button modal", "run", "cafe", "docs", "error message button", "md"])
def test_bm25_scores_are_those_of_the_full_text_index(spark, chunks, query):
    index = lexical.build_lexical(chunks, "porter")
    got = {r["id"]: r["score"] for r in lexical.bm25_scores(index, lexical.exploded(asked(spark, query), F.split("text", " "))).collect()}
    want = fts(" OR ".join(query.split()))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_bm25_filter_leaves_statistics_alone(spark, chunks):
    index = lexical.build_lexical(chunks)
    rows = asked(spark, ("button input", "other"), ("button input", None), source=True)
    some, all_ = ({r["id"]: r["score"] for r in lexical.bm25_search(index, rows, 10).where(F.col("query_id") == i).collect()} for i in (0, 1))
    assert set(some) == {"c4"} and some["c4"] == all_["c4"] and len(all_) == 4


def test_bm25_of_stopwords_repeats_and_large_k(spark, chunks):
    index = lexical.build_lexical(chunks)
    got = lexical.bm25_search(index, asked(spark, "the and of", "button", "button button", ""), 99).collect()
    by = {i: {r["id"]: r["score"] for r in got if r["query_id"] == i} for i in range(4)}
    assert not by[0] and not by[3] and all(abs(by[2][k] - 2 * by[1][k]) < 1e-5 for k in by[1])


def test_tfidf_against_brute_force(spark, chunks):
    import re

    from docmill.functions.vocabulary import TFIDF_STOPWORDS

    tokens = lambda t: [w for w in re.findall(r"\w+", t.lower()) if len(w) > 1 and w not in TFIDF_STOPWORDS]
    docs = {c[0]: tokens(c[3] + " " + c[4]) for c in CHUNKS}
    query = "Button button modal"
    want = {}
    for c in CHUNKS:
        ts = docs[c[0]]
        score = sum(ts.count(q) / len(ts) * math.log(len(CHUNKS) / sum(q in d for d in docs.values())) for q in tokens(query) if q in ts)
        score *= (1.5 if c[5] else 1) * (1 + 0.3 * len(set(tokens(query)) & set(re.findall(r"\w+", c[3].lower()))))
        if score > 0:
            want[c[0]] = round(score, 6)
    got = lexical.tfidf_search(lexical.build_tfidf(chunks), chunks, asked(spark, query), 10).orderBy("rank").collect()
    assert {r["id"]: r["score"] for r in got} == pytest.approx(want, abs=2e-6)
    assert [r["id"] for r in got] == sorted(want, key=lambda k: (-want[k], k))


def test_index_tables_round_trip(spark, chunks, tmp_path):
    index = lexical.build_lexical(chunks, "porter")
    store.save_lexical(index, str(tmp_path))
    again = store.load_lexical(spark, str(tmp_path))
    rows = asked(spark, "button error")
    assert lexical.bm25_search(again, rows, 5).collect() == lexical.bm25_search(index, rows, 5).collect()


def test_latest_write_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 0, "z")], "id string, seq int, v string")
    assert {(r["id"], r["v"]) for r in lexical.latest(rows).collect()} == {("a", "y"), ("b", "z")}


# Expansion.


def test_expansion_is_one_step_both_ways(spark):
    rows = expand.expanded_terms(asked(spark, "btn", "configuration", "dialog row", "zzz"), expand.expansions(spark)).collect()
    by = {i: {r["term"] for r in rows if r["query_id"] == i} for i in range(4)}
    assert by[0] == {"btn", "button"} and by[1] == {"configuration", "config"} and {"modal", "popup", "overlay", "row"} <= by[2] and by[3] == {"zzz"}


def test_custom_expansions(spark):
    table = expand.expansions(spark, [("K8S", "kubernetes")], [("pod", "container")])
    got = {r["term"] for r in expand.expanded_terms(asked(spark, "k8s container"), table).collect()}
    assert {"kubernetes", "pod", "grid", "layout"} <= got
    assert expand.expanded_query(asked(spark, "k8s pod"), table).first()["expanded"] == "k8s kubernetes pod container"


# Vectors.


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[10] = x[11] = x[12]
    x[20] = 0
    v = spark.createDataFrame([(i, [float(a) for a in r], f"s{i % 3}") for i, r in enumerate(x)], "id long, embedding array<double>, source_id string")
    q = spark.createDataFrame([(1, [float(a) for a in x[12]], None), (2, [float(a) for a in x[5]], "s1"), (3, [0.0] * 8, None)], "query_id int, embedding array<double>, source string")
    got = knn.nearest(v, q, 7).collect()
    for query, vec, ids in ((1, x[12], range(300)), (2, x[5], range(1, 300, 3)), (3, np.zeros(8), range(300))):
        score = {i: round(float(x[i] @ vec / max(np.linalg.norm(x[i]) * np.linalg.norm(vec), 1e-300)), 6) for i in ids}
        want = sorted(score, key=lambda i: (-score[i], i))[:7]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == query] == want
    with pytest.raises(Exception, match="dimensions"):
        knn.nearest(v, spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<double>"), 3).collect()
    assert knn.nearest(v, q.limit(0), 3).count() == 0
    many = v.withColumnRenamed("id", "query_id").drop("source_id")
    show = lambda df: sorted(map(str, df.collect()))
    assert show(knn.nearest(v, many, 3, most_queries=70)) == show(knn.nearest(v, many, 3))


def test_lsh_finds_most_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + rng.normal(size=(200, 16)) * 0.1
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    q = v.where("id < 20").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in knn.lsh_nearest(v, q, 2).collect()}
    assert sum((i, i + 200) in got for i in range(20)) >= 18


def test_lsh_recall_on_the_real_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 50 = 0 or id < 10").withColumnRenamed("id", "query_id")
    want, got = ({(r["query_id"], r["id"]) for r in f(v, q, 10).collect()} for f in (knn.nearest, knn.lsh_nearest))
    print(f"recall@10: {len(want & got) / len(want):.4f} of {len(want)}")
    assert len(want & got) >= 0.9 * len(want)


def test_embedding_batches_blanks_and_mismatch(spark, chunks):
    seen = []

    def provider(texts):
        assert all(t for t in texts) and len(texts) <= 2
        return np.ones((len(texts), 3))

    provider.name = "ones"
    rows = knn.embed(spark.createDataFrame([("a",), ("",), (None,)], "t string"), F.col("t"), provider, batch=2).collect()
    assert not seen and all(list(r["embedding"]) == [1, 1, 1] and r["provider"] == "ones" and r["dim"] == 3 for r in rows)
    index = build_hybrid(chunks)
    index.provider = provider
    with pytest.raises(ValueError, match="not made by"):
        hybrid_search(index, asked(spark, "button"))


def test_http_provider_sends_batches_and_keeps_order():
    import json

    from docmill.sources.providers import HttpProvider, provider

    sizes = []

    def send(body):
        texts = json.loads(body)["input"]
        sizes.append(len(texts))
        return json.dumps({"data": [{"index": i, "embedding": [len(t), 0.0]} for i, t in reversed(list(enumerate(texts)))]}).encode()

    p = HttpProvider("http://localhost/", "m", 2, batch=3, send=send)
    assert p(["a", "", "ccc", "dddd", "e" * 5, "f", "gg"])[:, 0].tolist() == [1, 1, 3, 4, 5, 1, 2] and sorted(sizes) == [1, 3, 3]
    with pytest.raises(ValueError, match="vectors came back"):
        HttpProvider("http://localhost/", "m", 2, send=lambda b: b'{"data": []}')(["a"])
    assert provider("auto").name.startswith(("hashing", "local")) and provider("http", url="u", model="m", dim=3).dim == 3
    with pytest.raises(ValueError, match="unknown provider"):
        provider("nope")


def test_uuids_are_those_of_the_standard_library(spark):
    import uuid

    from docmill.functions.text import uuid5

    rows = spark.createDataFrame([(x,) for x in ("", "a", "docs:é", "3f2a9c")], "c string")
    assert [r[0] for r in rows.select(uuid5(F.col("c"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in ("", "a", "docs:é", "3f2a9c")]


def test_many_queries_join_where_few_are_looked_up(spark, chunks, monkeypatch):
    index = build_hybrid(chunks, expansions=expand.expansions(spark))
    rows = asked(spark, "btn", "modal dialog page", "   ", "error message")
    few = [sorted(map(str, f().collect())) for f in (lambda: lexical.bm25_search(index.lexical, rows, 3, chunks), lambda: hybrid_search(index, rows, 2))]
    assert "**modal**" in str(few[0]) and "**error**" in str(few[0]) and len(few[1]) == 6
    from docmill.plans import search, shared

    for module in (lexical, search, knn):
        monkeypatch.setattr(module, "few", lambda df, most=0: shared.few(df, 1))
    assert [sorted(map(str, f().collect())) for f in (lambda: lexical.bm25_search(index.lexical, rows, 3, chunks), lambda: hybrid_search(index, rows, 2))] == few


def test_marked_snippet(spark):
    from docmill.functions.text import marked_snippet

    rows = spark.createDataFrame([("w " * 40 + "Needle, here " + "z " * 40,), ("needle",), ("none at all",), ("",)], "c string")
    got = [r[0] for r in rows.select(marked_snippet(F.col("c"), F.array(F.lit("needle")), 8)).collect()]
    assert got == ["...w w **Needle,** here z z z z...", "**needle**", "none at all", ""]


# Fusion and hybrid search.


@given(st.lists(st.integers(1, 50), max_size=2))
def test_rrf_is_bounded(ranks):
    assert sum(w / (60 + r) for w, r in zip((0.4, 0.6), ranks, strict=False)) <= 1 / 61


def test_fuse(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 5)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    got = {r["id"]: (r["score"], r["lexical_rank"], r["vector_rank"]) for r in fuse.fuse(a, b).collect()}
    assert got == {"x": (0.4 / 65, 5, None), "y": (0.4 / 62 + 0.6 / 61, 2, 1), "z": (0.6 / 62, None, 2)}


def test_hybrid_search(spark, chunks):
    index = build_hybrid(chunks, expansions=expand.expansions(spark))
    rows = hybrid_search(index, asked(spark, ("btn", None), ("   ", None), ("modal", "other"), source=True), 3).collect()
    first = sorted((r for r in rows if r["query_id"] == 0), key=lambda r: r["rank"])
    assert len(first) == 3 and first[0]["id"] == "c1" and "button" in first[0]["snippet"].lower()
    assert not [r for r in rows if r["query_id"] == 1] and {r["source_id"] for r in rows if r["query_id"] == 2} == {"other"}
