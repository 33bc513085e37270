"""Corpus operators against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from docmill.llm import decontam, langid, minhash, mixing, vectors
from docmill.llm.components import connected_components
from docmill.llm.words import shingle_set, word_hashes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def sets_of(rows, size):
    out = []
    for _, text in rows:
        w = SPACE.findall(lower(text or ""))
        out.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# Words and components.


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n\x0b\u00a0Z", max_size=40)), max_size=8))
def test_word_hashes_follow_words(texts):
    import pyarrow as pa

    got = list(word_hashes(pa.array(texts, pa.string())))
    seen = {}
    for t, h in zip(texts, got, strict=True):
        words = SPACE.findall(lower(t or ""))
        assert len(words) == len(h)
        for w, x in zip(words, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_of_a_very_long_text():
    import pyarrow as pa

    text = ("ab " * 400_000 + "x" * 3_000_000 + " ") * 2
    got = list(word_hashes(pa.array(["ab", text, "x" * 3_000_000])))
    assert len(got[1]) == 800_002 and got[1][0] == got[0][0] and got[1][400_000] == got[2][0]
    assert len(shingle_set(got[1], 3)) == 4


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_connected_components(spark, links):
    found = connected_components(spark.createDataFrame(links, "u long, v long"))
    real = [(a, b) for a, b in links if a != b]
    nodes = {n for e in real for n in e}
    assert {r["node"]: r["component"] for r in found.collect()} == components(nodes, real)


def test_components_of_a_chain(spark):
    found = connected_components(spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 201


# MinHash.


def near_rows():
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv")
    base = [[word() for _ in range(rng.choice([5, 30, 120]))] for _ in range(25)]
    rows = []
    for b in base:
        rows.append(" ".join(b))
        for _ in range(rng.randrange(6)):
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = word()
            rows.append(" ".join(c).upper() if rng.random() < 0.3 else " ".join(c))
    # A hub that is not the least id: its copies are alike to it but not all to each other.
    hub = [word() for _ in range(60)]
    spokes = []
    for k in range(40):
        c = list(hub)
        c[1 + k] = "zz%d" % k
        spokes.append(" ".join(c))
    rows += [*spokes, " ".join(hub)]
    rows += [None, "", " \n\t", "one", "One", "one two", "two one", LONG, LONG.upper(), LONG + " tail"]
    return list(enumerate(rows))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_minhash_against_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = near_rows()
    sets = sets_of(rows, size)
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = components(range(len(rows)), links)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("keys", F.lit(0))
    for r in minhash.near_duplicates(docs, size=size, percent=percent).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i), rows[i]


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_size_classes_of_similar_sets_are_neighbours(spark, percent):
    sizes = spark.range(1, 400).select(F.col("id").alias("n"), minhash.size_class(F.col("id"), percent).alias("c"))
    of = {r["n"]: r["c"] for r in sizes.collect()}
    assert all(of[m] - of[n] in (0, 1) for n in of for m in range(n, min(399, n * 100 // percent) + 1))


def test_minhash_of_sets_that_share_buckets_but_not_sizes(spark, monkeypatch):
    """Prefixes of one text: links join neighbouring lengths only, over many size classes and blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate([*range(20, 60, 2), *range(100, 140, 5), *range(300, 400, 9)])] + [(900 + i, " ".join([*words[:50], *(f"x{i}{k}" for k in range(4))])) for i in range(12)]
    sets = sets_of(rows, 3)
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = components(range(len(rows)), links)
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85, bands=60, rows=3).collect()}
    assert out == {rows[i][0]: rows[want[i]][0] for i in want} and len(set(want.values())) >= 3


def test_minhash_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    rows = [(5, text), (5, text), (2, text + " x"), (5, other), (9, other), (None, text), (None, None)]
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(5, 2, False)] * 3 + [(2, 2, True), (9, 2, False), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Vectors.


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = [(i, base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.3]), int(rng.integers(3))) for i in range(500)]
    rows += [(500 + i, base[0] + rng.normal(size=16) * 0.02, 0) for i in range(150)]
    rows = [(i, [float(x) for x in np.float32(v)], y) for i, v, y in rows]
    rows += [(700, rows[0][1], rows[0][2]), (701, [2 * x for x in rows[0][1]], rows[0][2]), (702, None, 0), (703, [0.0] * 16, 0), (704, [float("nan")] * 16, 0), (705, [float("inf")] + [1.0] * 15, 0), (706, [None] + [1.0] * 15, 0), (707, rows[0][1], None), (708, [1.0, 1.0], 0), (709, [1.0, 1.1], 0), (710, [], 0), (711, [3e38] * 16, 1), (712, [2e38] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("keys", F.lit(1)).withColumn("h", F.lit(1))
    good = {i: np.array(v, float) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in rows}
    links = []
    for a, b in itertools.combinations(good, 2):
        if label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.93:
            links.append((a, b))
    want = components([r[0] for r in rows], links)
    n = {i: sum(i in e for e in links) for i in label}
    out = {r["vec_id"]: r for r in vectors.near_vectors(table).collect()}
    found = sum(r["n_links"] for r in out.values())
    assert found <= 2 * len(links) and found >= 0.995 * 2 * len(links)
    assert sum(out[i]["component_id"] == want[i] for i in want) >= 0.99 * len(want)
    for i in (*range(500, 650), *range(700, 713)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (n[i], want[i], want[i] == i)
    assert vectors.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [16, 64, 384, 1536])
def test_vectors_recall_by_dimension(spark, dim):
    """Pairs at a cosine just above the bound, which are the hardest to find."""
    rng = np.random.default_rng(dim)
    n = 1000
    a, noise = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * noise
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate((a, b)))]
    out = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(out[n + i]["component_id"] == out[i]["component_id"] for i in range(n)) / n
    print(f"recall in {dim} dimensions: {found}")
    assert found >= 0.99


def test_vectors_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (4, [1.0, 0.0], 2)]
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert out == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True), (4, 1, 4, True), (4, 1, 4, True)], key=str)


def test_hadamard_is_orthonormal():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), x)


# Mixing.


def test_targets_are_filled_like_water():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 5}, (5, 2, 1), 3)
    assert got["a"] == 30 and got[None] == 15
    assert abs(sum(got.values()) - 2015) < 1e-9 and abs(got["b"] / got["c"] - 2) < 1e-9
    assert mixing.targets({}, (1,), 3) == {} and mixing.targets({"a": 0}, (1,), 3) == {"a": 0}


def flow_cost(supply, sent, costs):
    total = 0
    for size, flow in zip(supply, sent, strict=True):
        words = sum(flow.values())
        for c in costs:
            total += c * min(size, words)
            words -= min(size, words)
        assert words == 0
    return total


def test_min_cost_flow_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        supply, arcs = [rng.randrange(3) for _ in range(3)], [(0, 0), (1, 1), (2, 0), (2, 1)]
        quota, costs = [rng.randrange(6), rng.randrange(6)], (0, 1, 3)
        sent = mixing.min_cost_flow(supply, arcs, quota, costs)
        best = min(
            ((-(a + b + c + d), flow_cost(supply, [{0: a}, {1: b}, {0: c, 1: d}], costs)) for a in range(3 * supply[0] + 1) for b in range(3 * supply[1] + 1) for c in range(3 * supply[2] + 1) for d in range(3 * supply[2] + 1 - c) if a + c <= quota[0] and b + d <= quota[1])
        )
        assert (-sum(w for f in sent for w in f.values()), flow_cost(supply, sent, costs)) == best
        apart = mixing.route([*supply, 5, 0], [*arcs, (3, 2)], [*quota, 12, 7], costs)
        assert apart[:3] == sent and apart[3:] == [{2: 12}, {}]


def test_mix_reaches_targets_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(3000)] + [(1, None, "a"), (1, "w w", "a"), (1, "w w", "a"), (None, "w", ""), (9000, LONG, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("pattern", F.lit(1)).withColumn("order", F.lit(1))
    out = mixing.mix(docs).withColumn("s", F.col("doc_id")).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).withColumn("s", F.col("doc_id")).collect()))
    by = {}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        t = by.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["taken"]
        t[1] = max(t[1], r["size"])
    for (_, target), (taken, largest) in by.items():
        assert abs(taken - target) <= largest / 2 + 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_min_cost_flow_of_many_patterns_against_linear_programming_bounds():
    rng = random.Random(8)
    sources = 40
    arcs = sorted({(p, s) for p in range(3000) for s in rng.sample(range(sources), rng.randrange(1, 5))})
    supply, costs = [rng.randrange(1, 100) for _ in range(3000)], (0, 1, 3)
    quota = [rng.randrange(2 * sum(supply) // sources) for _ in range(sources)]
    sent = mixing.min_cost_flow(supply, arcs, quota, costs)
    got = [0] * sources
    for p, flow in enumerate(sent):
        assert sum(flow.values()) <= 3 * supply[p] and all((p, s) in set(arcs) for s in list(flow)[:1])
        for s, w in flow.items():
            got[s] += w
    assert all(g <= q for g, q in zip(got, quota, strict=True)) and sum(got) >= 0.99 * min(sum(quota), 3 * sum(supply))
    # No cycle through a pattern that is used less and one that is used more makes it cheaper: no source takes a second use where a first use is left beside it.
    uses = [sum(f.values()) / n for f, n in zip(sent, supply, strict=True)]
    by = {}
    for p, s in arcs:
        by.setdefault(s, []).append(p)
    assert not any(uses[p] < 1 and uses[q] > 1 and sent[q].get(s) for s, ps in by.items() for p in ps for q in ps)


def overlapping(rng, n, names):
    return [(i, "w " * rng.randrange(1, 40), rng.sample(names, rng.randrange(1, 4)) if rng.random() < 0.9 else None) for i in range(n)]


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(6)
    rows = overlapping(rng, 1500, ["a", "b", "c", "d"])
    out = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(4, 1)).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    patterns, sizes = {}, {}
    for i, _, ss in rows:
        key = tuple(sorted(set(ss))) if ss else (None,)
        patterns.setdefault(key, []).append(i)
        for s in key:
            sizes[s] = sizes.get(s, 0) + size[i]
    goal = mixing.targets(sizes, (4, 1), 3)
    keys, names = sorted(patterns, key=str), list(goal)
    supply = [sum(size[i] for i in patterns[k]) for k in keys]
    sent = mixing.min_cost_flow(supply, [(p, names.index(s)) for p, k in enumerate(keys) for s in k], [round(goal[s]) for s in names], (0, 1, 3))
    words = {k: sum(out[i]["taken"] for i in patterns[k]) for k in keys}
    assert abs(sum(words.values()) - sum(sum(f.values()) for f in sent)) <= 20 * len(keys)
    for k in keys:
        assert {round(out[i]["target"], 6) for i in patterns[k]} == {round(sum(goal[s] for s in k), 6)} and {out[i]["source_size"] for i in patterns[k]} == {sum(sizes[s] for s in k)}
        uses = [out[i]["taken"] // size[i] for i in patterns[k]]
        assert max(uses) - min(uses) <= 1 and all(out[i]["taken"] % size[i] == 0 for i in patterns[k])


def test_mix_of_more_patterns_than_the_driver_holds(spark):
    rng = random.Random(7)
    rows = overlapping(rng, 400, ["a", "b", "c"]) + [(1000 + i, t, ss and [f"x{s}" for s in ss]) for i, t, ss in overlapping(rng, 400, ["d", "e"] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    show = lambda **k: sorted(map(str, mixing.mix(docs, **k).collect()))
    assert show(driver_patterns=3) == show()


def test_mix_of_equal_rows_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)
    rows = [(None, "w w w", "a", k % 2) for k in range(50)] + [(7, "w w", "a", k) for k in range(30)] + [(8, "w " * (k % 3), "b", k) for k in range(200)] + [(9, None, "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(docs, carry=["size", "text"]).collect()
    assert sorted((r["doc_id"], r["carried"]["text"], r["carried"]["size"]) for r in out if r["doc_id"]) == sorted((r[0], r[1], r[3]) for r in rows if r[0])
    assert len(out) == len(rows) and all(r["size"] == len((r["carried"]["text"] or "").split()) for r in out)
    for target in {r["target"] for r in out}:
        assert abs(sum(r["taken"] for r in out if r["target"] == target) - target) <= 3
    show = lambda rs: sorted(str(tuple(r)[:6]) for r in rs)
    assert show(out) == show(mixing.mix(docs.repartition(5), carry=["size", "text"]).collect())


# Language ID.


def corpus():
    rng = random.Random(2)
    ends = {"en": ["ing", "tion", "the", "ed"], "de": ["ung", "keit", "lich", "der"], "fr": ["eaux", "é", "ment", "les"]}
    word = lambda lang: rng.choice("bcdfgl") + rng.choice(["a", "o", "i"]) + rng.choice(ends[lang])
    sentence = lambda lang: " ".join(word(lang) for _ in range(8)).capitalize() + "."
    rows = [(i, " ".join(sentence(x) for _ in range(4)), x) for i in range(600) for x in [rng.choice(list(ends))]]
    return rows, sentence


def test_language_id(spark):
    rows, sentence = corpus()
    mixed = " ".join(sentence("de") for _ in range(30)) + " " + " ".join(sentence("fr") for _ in range(10))
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 -- !", "de"), (1003, "«—» 。", None), (1004, mixed, None), (1005, (sentence("fr") + "\n") * 40_000, None), (1006, "x" * 2_500_000, None), (None, sentence("de") * 5, "de"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("version", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("fold", F.lit(1))
    out = langid.identify(docs, per_label=60).collect()
    assert len(out) == len(rows) + len(odd)
    got = {r["doc_id"]: r for r in out}
    held = [(r, got[r[0]]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(g["held_out"] for _, g in held) and sum(g["held_out"] for i, g in got.items() if i is not None and i < 600) == len(held)
    assert sum(g["lang_pred"] == r[2] for r, g in held) / len(held) >= 0.98
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und"] * 4 and got[1000]["score"] == 0
    assert got[1004]["lang_pred"] == "de" and 0.6 < got[1004]["score"] < 0.9
    assert got[1005]["lang_pred"] == "fr" and got[None]["lang_pred"] == "de" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(60)}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, 3_000 + i if lang == "l00" else 30), lang) for i, lang in enumerate(list(words) * 12)]
    rows += [(10_000 + i, text(lang, 30), lang) for i, lang in enumerate(list(words)[1:51] * 3)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=300).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(out) == len(rows) and {r["lang_pred"] for r in out} == set(words)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in out)


def test_the_sample_of_a_language(spark):
    rows = [(i, "a" * n, lang) for i, (lang, n) in enumerate([("long", 500 + k) for k in range(40)] + [("short", 50 + k) for k in range(40)] + [("short", 700), ("few", 30), ("few", 900), ("few", 901)] * 4)]
    texts, langs = langid.training_sample(spark.createDataFrame(rows, "id long, t string, l string"), "id", "t", "l", 25, 100, 10)
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sizes = lambda lang: sorted(len(t) for t, x in zip(texts, langs, strict=True) if x == lang)
    assert sizes("long") == [min(len(t) for _, t, x in known if x == "long")]
    assert len(sizes("short")) == 20 and max(sizes("short")) <= 100
    few = sum(len(t) == 30 for _, t, x in known if x == "few")
    assert sizes("few") == [30] * few + ([900] if few < 4 else [])


def test_forward_backward_against_brute_force():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    sentence = np.array([0, 0, 0, 0, 1, 2, 2])
    marg, moved, z = langid.forward_backward(emit, sentence, trans)
    want, want_moved, want_z = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for s in range(3):
        at = np.flatnonzero(sentence == s)
        paths = list(itertools.product(range(3), repeat=len(at)))
        w = np.array([np.exp(sum(emit[i, y] for i, y in zip(at, p, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        want_z += np.log(w.sum())
        for p, x in zip(paths, w / w.sum(), strict=True):
            for i, y in zip(at, p, strict=True):
                want[i, y] += x
            for a, b in itertools.pairwise(p):
                want_moved[a, b] += x
    assert np.allclose(marg, want) and np.allclose(moved, want_moved) and np.isclose(z, want_z)


# Decontamination.


def brute_hits(docs, items, window):
    out = []
    windows = {}
    for item, text in items:
        w = TERM.findall(lower(text or ""))
        if item is not None and w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w = TERM.findall(lower(text or ""))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def bench_rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "École", "a", "X1", "foo", "bar", "Baz", "qux"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 10, 15, 30])))) for i in range(12)] + [(3, "the the the"), (None, "of of"), (20, None), (21, "--"), (22, "the-the, the!"), (100, "école a a"), (9, "École a a")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(60))]
        if i % 3 == 0 and w:
            w[rng.randrange(len(w)) : 0] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, rng.choice(["", " ", "... "]) + rng.choice([" ", ", ", "\n"]).join(w) + rng.choice(["", "!"])))
    docs += [(500, None), (501, ""), (502, "??"), (503, LONG + " " + items[5][1]), (7, docs[9][1]), (None, docs[12][1]), (None, docs[12][1]), (7, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("window", [3, 10])
def test_decontamination_against_brute_force(spark, window):
    docs, items = bench_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("version", F.lit("clash")).withColumn("item", F.lit(1)).withColumn("n_hit", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1)).withColumn("n", F.lit(1)).withColumn("term", F.lit(1))
    out = [tuple(r) for r in decontam.decontaminate(d, b, window=window).collect()]
    assert sorted(out, key=str) == sorted(brute_hits(docs, items, window), key=str)


def test_decontamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in decontam.decontaminate(d, b.limit(0)).collect()] == [(1, 2, 0, 0, empty, False)]
    assert decontam.decontaminate(d.limit(0), b).count() == 0
    assert [tuple(r)[2:4] for r in decontam.decontaminate(d, b).collect()] == [(2, 1)]


def test_near_matches_against_brute_force(spark):
    docs, items = bench_rows()
    docs, items = docs[:60], [(i, t) for i, t in items[:8]]
    table = decontam.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    terms, places = decontam._terms(table)
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"), terms)
    window, slop = 4, 2
    got = decontam.near_matches(index, places.select("item", "n", "place", "term_id"), window, slop).join(table.select("item", "id").distinct(), "item")
    found = {(r["doc"], int(r["id"]), r["start"]) for r in got.collect()}
    want = set()
    for item, text in items:
        w = TERM.findall(lower(text))
        n = min(window, len(w))
        for s in range(len(w) - n + 1):
            need = set(w[s : s + n])
            for doc, t in docs:
                x = TERM.findall(lower(t))
                if any(need <= set(x[i : i + n + slop]) for i in range(max(1, len(x) - 0))):
                    want.add((doc, item, s))
    assert found == want
