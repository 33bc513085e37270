"""Terms of several parts, and marked snippets, against SQLite's full-text index."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from docmill.functions.schema import as_chunks
from docmill.functions.snippets import best_snippet
from docmill.operators import lexical
from docmill.plans.search import build_hybrid, hybrid_search
from docmill.sources import store

TEXTS = [
    ("c1", "app", "src/get_user.py", "get_user", "Call get_user() to get the user. get_user_name gives the name."), ("c2", "app", "docs/user.md", "User get", "users: get first, then user"), ("c3", "lib", "docs/_foo.md", "The foo_bar setting", "foo-bar is foo.bar; foo foo foo"),
    ("c4", "lib", "docs/x.md", "bar then foo", "ends with get"), ("c5", "lib", "user/y.md", "user", "running_tests run tests"), ("c6", "lib", "z", "", ""), ("c7", "lib", "w", "café_crème", "CAFE_CREME __init__ is_valid __"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(*t, False, i) for i, t in enumerate(TEXTS)]
    return as_chunks(spark.createDataFrame(rows, "id string, source_id string, path string, title string, content string, is_entrypoint boolean, seq long")).cache()


def fts(texts, analyzer="porter unicode61"):
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table t using fts5(id, source_id, path, title, content, tokenize='{analyzer}')")
    db.executemany("insert into t values (?, ?, ?, ?, ?)", [(a, b, c, d.lower(), e.lower()) for a, b, c, d, e in texts])
    return db


def scores(spark, index, *terms, source=None):
    rows = spark.createDataFrame([(1, t, *([source] if source else [])) for t in terms], "query_id int, term string" + (", source string" if source else ""))
    return {r["id"]: r["score"] for r in lexical.bm25_scores(index, rows, source is not None).collect()}


def same(got, want):
    return got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("terms", [["get_user"], ["foo_bar"], ["foo_foo"], ["get_user_name", "user"], ["_foo"], ["__init__"], ["running_tests"], ["cafe_creme"], ["get_user", "get_user", "foo_bar"], ["users_get"], ["bar_nothing", "bar"], ["then_user"], ["md_user"]])
def test_phrase_scores_are_those_of_the_full_text_index(spark, chunks, terms, monkeypatch):
    index = lexical.build_lexical(chunks, "porter", positions=True)
    want = {r[0]: -r[1] for r in fts(TEXTS).execute("select id, bm25(t) from t where t match ?", (" OR ".join(terms),))}
    assert same(scores(spark, index, *terms), want)
    if terms in (["get_user", "get_user", "foo_bar"], ["users_get"]):
        monkeypatch.setattr(lexical, "few", lambda df, most=0: None)  # as for very many queries
        assert same(scores(spark, index, *terms), want)


def test_phrases_of_random_texts(spark):
    rng = random.Random(8)
    texts = [(f"i{i}", "s", "p", " ".join(rng.choice("abc") for _ in range(rng.randrange(4))), rng.choice(["_", " ", "-"]).join(rng.choice("abcd") * 2 for _ in range(rng.randrange(30)))) for i in range(60)]
    rows = as_chunks(spark.createDataFrame([(*t, False, i) for i, t in enumerate(texts)], "id string, source_id string, path string, title string, content string, is_entrypoint boolean, seq long"))
    index, db = lexical.build_lexical(rows, positions=True), fts(texts, "unicode61")
    for terms in (["aa_bb"], ["aa_aa_bb", "cc"], ["dd_cc_aa_bb", "a_b"]):
        assert same(scores(spark, index, *terms), {r[0]: -r[1] for r in db.execute("select id, bm25(t) from t where t match ?", (" OR ".join(terms),))})


def test_phrases_of_a_source_and_of_no_positions(spark, chunks, tmp_path):
    index = lexical.build_lexical(chunks, "porter", positions=True)
    every = scores(spark, index, "foo_bar", "user")
    some = scores(spark, index, "foo_bar", "user", source="lib")
    assert some == {k: every[k] for k in ("c3", "c5")} and "c1" in every
    store.save_lexical(index, str(tmp_path))
    assert scores(spark, store.load_lexical(spark, str(tmp_path)), "get_user") == scores(spark, index, "get_user")
    with pytest.raises(ValueError, match="positions"):
        scores(spark, lexical.build_lexical(chunks), "get_user")


def test_identifiers_are_found_by_the_engine(spark, chunks):
    rows = spark.createDataFrame([(1, "foo_bar"), (2, "is_valid setting")], "query_id int, text string")
    from docmill.operators.expand import expansions

    for known in (None, expansions(spark)):
        got = hybrid_search(build_hybrid(chunks, expansions=known), rows, 3).where("lexical_rank is not null")
        assert {(r["query_id"], r["id"]) for r in got.collect()} >= {(1, "c3"), (2, "c7"), (2, "c3")}
        assert got.where("query_id = 1 and id = 'c4'").count() == 0


def fts_snippet(content, query, size):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content, tokenize='unicode61')")
    db.execute("insert into t values (?)", (content,))
    return next(iter(db.execute("select snippet(t, 0, '**', '**', '...', ?) from t where t match ?", (size, query))), [None])[0]


def test_best_snippets_are_those_of_the_full_text_index(spark):
    rng = random.Random(2)
    cases = []
    for n in (3, 12, 40, 90, 200):
        for _ in range(30):
            words = [rng.choice("uvwxyz") * 2 if rng.random() < 0.85 else rng.choice(["alpha", "beta", "gamma"]) for _ in range(n)]
            if rng.random() < 0.4:
                words = [w + rng.choice(["", ".", ",", " —"]) for w in words]
            cases.append((" ".join(words), rng.sample(["alpha", "beta", "gamma"], rng.choice([1, 2, 3]))))
    cases += [("alpha", ["alpha"]), ("no such word", ["alpha"]), ("", ["alpha"]), (None, ["alpha"]), ("x " * 3000 + "beta alpha", ["alpha", "beta"]), ("(alpha) - beta!", ["alpha", "beta"])]
    for size in (8, 32):
        rows = spark.createDataFrame([(i, c, ts) for i, (c, ts) in enumerate(cases)], "i int, content string, terms array<string>")
        got = {r["i"]: r["s"] for r in rows.select("i", best_snippet(F.col("content"), F.col("terms"), size).alias("s")).collect()}
        for i, (c, ts) in enumerate(cases):
            want = fts_snippet(c, " OR ".join(ts), size) if c is not None else None
            assert got[i] == want, (size, c, ts)
