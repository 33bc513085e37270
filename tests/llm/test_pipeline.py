"""Every stage of the pipeline against a brute-force version, and the registered queries."""

import random

import __spark_entry__
import corpus_pipeline
import pytest
from docmill.llm import langid, queries
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import SPACE, TERM, brute_hits, components, corpus, lower, sets_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, sentence = corpus()
    docs = [(i, t, lang, f"s{i % 4}" if i % 9 else None, len(t)) for i, t, lang in rows[:300]]
    items = [(i, " ".join(sentence("en") for _ in range(3))) for i in range(5)]
    docs += [(1000 + i, docs[i][1] + " " + docs[i + 1][1] + f" tail{i % 2}", docs[i][2], "s1", 1) for i in range(10) for _ in range(1)]
    docs += [(2000 + i, docs[300 + i][1].upper(), docs[i][2], "s2", 1) for i in range(5)]
    docs += [(3000 + i, docs[i][1] + " " + items[i % 5][1].lower() + " end", "en", "s3", 1) for i in range(10)]
    docs += [(4000, None, None, None, None), (4001, "123 --", "en", "s0", 6), (4002, " ".join(sentence(x) for x in ("en", "de", "fr") * 5), None, "s0", 1), (5, docs[5][1], docs[5][2], docs[5][3], docs[5][4]), (None, sentence("de") * 9, "de", "s9", 1)]
    rng.shuffle(docs)
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_stages_against_brute_force(spark, folder, tmp_path):
    d, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 3:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append([tuple(r) for r in docs.select(COLUMNS).collect()])
    start = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    # Language ID: each kept row passes, each dropped row fails, and nothing is changed.
    judged = {(r["doc_id"], r["lang_pred"] != "und" and r["score"] >= 0.4) for r in langid.identify(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    assert sorted(outs[0], key=str) == sorted([r for r in start if (r[0], True) in judged], key=str)
    assert {4000, 4001, 4002} & {r[0] for r in outs[0]} == set() and len(outs[0]) > 300
    # Near-duplicates.
    rows = [(r[0], r[1]) for r in outs[0]]
    sets = sets_of(rows, 3)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    links += [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[i][0] == rows[j][0]]
    group = components(range(len(rows)), links)
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    want = sorted({rows[i][0] for i in group if rows[i][0] is not None and least[group[i]] == rows[i][0]} | {None}, key=str)
    assert sorted([r[0] for r in outs[1]], key=str) == want
    # Decontamination.
    hit = {h[0] for h in brute_hits([(r[0], r[1]) for r in outs[1]], items, 10) if h[5]}
    assert len(hit) >= 5 and sorted([r[0] for r in outs[2]], key=str) == sorted([r[0] for r in outs[1] if r[0] not in hit], key=str)
    # Mixing: whole copies, near the targets.
    last = docs.collect()
    have = {r[0]: len(SPACE.findall(r[1] or "")) for r in outs[2]}
    assert all(r["taken"] == r["copies"] * r["size"] and 1 <= r["copies"] <= 3 and r["size"] == have[r["doc_id"]] for r in last)
    assert abs(sum(r["taken"] for r in last) - sum(have.values())) <= 5 * max(have.values())
    assert len({r["doc_id"] for r in last}) == len(last)


def test_near_duplicates_are_those_of_five_words_and_four_fifths(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join(t.split()[: 74 + i])) for i, t in enumerate(texts)]
    rows += [(200 + i, " ".join(w if k % (15 + 7 * i) else "other" for k, w in enumerate(t.split()))) for i, t in enumerate(texts)]
    sets = sets_of(rows, 5)
    group = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(*r, "en", "s0", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    assert sorted(r["doc_id"] for r in out) == sorted(least.values()) and 108 not in {r["doc_id"] for r in out}


def test_a_contaminated_row_takes_no_clean_one_of_its_id_along(spark, folder):
    d, items = folder
    rows = [(i, text, "en", "s0", 1) for i in (None, 7) for text in (f"see {items[0][1]} end", "a clean text of some words", "another clean text", None)]
    out = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), d).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out))) == sorted(str(r[:2]) for r in rows if not (r[1] or "").startswith("see"))


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_equal_rows_are_mixed_one_by_one(spark):
    text = " ".join(f"w{i}" for i in range(4))
    rows = [(i, f"{text} {i}"[:-1], "en", "a", 1) for i in range(12)] + [(100 + i // 6, text, "en", "ab"[i // 6], 1) for i in range(12)]
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, KIND), "").collect()
    words = sum(len(r[1].split()) for r in rows)
    assert abs(sum(r["taken"] for r in out) - words) <= 4 and len(out) <= len(rows) and all(r["copies"] <= 3 for r in out)


CLASHES = ["d", "v", "gone_id", "gone_version", "version", "size", "taken", "copies", "id", "row", "n", "carried", "score", "kept", "doc", "pattern", "contaminated"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_clashing_columns_long_texts_and_no_rows(spark, folder, name, stage):
    d, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    plain = stage(spark, docs, d)
    more = docs
    for c in CLASHES:
        more = more.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    out = stage(spark, more, d)
    show = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert show(out.select(COLUMNS).collect()) == show(plain.select(COLUMNS).collect())
    if name != "mixing":
        assert out.columns == more.columns and all(r["d"] == f"d of {'-' if r['doc_id'] is None else r['doc_id']}" for r in out.collect())
    assert stage(spark, docs.limit(0), d).count() == 0
    sentence = "the the fothe boing bithe loted and more words of it. "
    long = [(1, sentence * 30_000, "en", "s0", 1), (2, sentence * 30_000 + items[0][1], "en", "s0", 1), (3, "x" * 300_000, "en", "s0", 1), (None, "", None, None, None), (4, None, "en", None, None)]
    rows = stage(spark, docs.unionByName(spark.createDataFrame([(i and 10_000 + i, *r) for i, *r in long], KIND)), d).collect()
    found = {r["doc_id"] - 10_000 for r in rows if r["doc_id"] and r["doc_id"] > 10_000}
    if name == "mixing":  # takes what the seed says, and never what has no words
        assert found <= {1, 2, 3}
    else:
        assert found - ({3} if name == "language_id" else set()) == {"language_id": {1, 2}, "near_duplicates": {1, 2, 3, 4}, "decontamination": {1, 3, 4}}[name]


def test_run_gives_the_same_as_its_stages(spark, folder):
    once, again = (sorted(map(str, corpus_pipeline.run(spark, folder[0]).collect())) for _ in range(2))
    assert once == again and len(once) > 100


def test_a_query_for_each_operator():
    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 13)] and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_helpers_agree():
    assert TERM.findall(lower("A-b É")) == ["a", "b", "É"]
