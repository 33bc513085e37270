"""Ball k-means and the token store against brute force, their codes, and edge cases."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from docmill.llm import clusters, queries, token_store
from docmill.llm.eliasfano import EliasFano
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# Clusters.


def lloyd(rows, k, rounds, scale=1024, width=64):
    """rows: (id, floats). Plain rounds over Python's whole numbers."""
    clip = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    kept = [(i, [clip(math.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    centroids = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for t in range(rounds + 1):
        own = [min((apart(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
        if t < rounds:
            for j in range(len(centroids)):
                members = [x for (_, x), (_, o) in zip(kept, own, strict=True) if o == j]
                if members:
                    centroids[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    top = (1 << 63) - 1
    inertia = [min(top, sum(d for d, o in own if o == j)) for j in range(len(centroids))]
    return [(i, o, min(top, d), inertia[o], min(top, sum(d for d, _ in own)), digest[o]) for (i, _), (d, o) in zip(kept, own, strict=True)]


def blobs(n, width, groups, spread, seed=1):
    rng = random.Random(seed)
    centres = [[rng.uniform(-3, 3) for _ in range(width)] for _ in range(groups)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("groups,spread,k", [(8, 0.2, 8), (3, 1.5, 8), (20, 0.01, 6)])
def test_ball_kmeans_against_brute_force(spark, groups, spread, k):
    rows = blobs(250, 64, groups, spread)
    rows += [(1000, rows[0][1]), (0, rows[1][1]), (0, rows[0][1]), (None, rows[2][1]), (1001, None), (1002, []), (1003, [1.0] * 63), (1004, [None] + [1.0] * 63), (1005, [float("nan")] + [1.0] * 63), (1006, [float("inf")] + [1.0] * 63)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("x", F.lit("clash")).withColumn("row", F.lit(1)).repartition(5)
    got = clusters.cluster_vectors(d, k=k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(lloyd(rows, k, 10), key=str)


def test_annuli_leave_most_centroids_out(spark):
    rows = blobs(600, 16, 30, 0.05, seed=4)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = clusters.ball_kmeans(clusters.written(clusters.whole_vectors(d, "vec_id", "embedding", 16, 1024), "x"), 30, 10)
    assert found.compared[0] == 600 * 30 and min(found.compared[1:]) < 600 * 30 / 5
    assert sum(found.members) == 600


def test_large_components_and_ties(spark):
    """Whole numbers beyond what doubles hold; equal distances; two vectors for eight clusters; all vectors equal."""
    big = [(i, [1e9 * (i % 4), -1e9] + [float(i)] * 62) for i in range(12)] + [(20, [3e38] * 64), (21, [-3e38] * 64)]
    ties = [(i, [float(i % 3)] + [0.0] * 63) for i in range(9)]
    for rows in (big, ties, ties[:2], [(i, [0.5] * 64) for i in range(20)]):
        d = spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
        want = lloyd([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 8, 10)
        assert sorted(map(tuple, clusters.cluster_vectors(d).collect())) == sorted(want)


def test_clusters_of_empty_tables(spark):
    d = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    for rows in (d, d.limit(0)):
        assert clusters.cluster_vectors(rows).collect() == []


# Elias-Fano codes.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 30), st.integers(0, 1 << 40), st.integers(-(1 << 63), (1 << 63) - 1)), max_size=1200), st.integers(0, 5))
def test_elias_fano_gives_back_its_numbers(values, shift):
    values = np.sort(np.array(values, np.int64) >> shift)
    code, end = EliasFano.from_bytes(b"xy" + EliasFano.encode(values).to_bytes() + b"z", 2)
    assert len(EliasFano.encode(values).to_bytes()) == end - 2
    assert code.slice(0, len(values)).tolist() == values.tolist()
    for i in range(0, len(values), 97):
        assert code[i] == values[i] and code.slice(i, min(len(values), i + 5)).tolist() == values[i : i + 5].tolist()
        assert code.find(int(values[i])) == int(np.searchsorted(values, values[i]))


def test_elias_fano_space_and_select():
    rng = np.random.default_rng(0)
    for values in (np.cumsum(rng.integers(1, 900, 50_000)), np.repeat(np.array([5, 1 << 33]), 40_000), np.concatenate((np.zeros(3000, np.int64), np.arange(70_000) * 1000))):
        code = EliasFano.encode(values)
        bits = 8 * len(code.to_bytes()) / len(values)
        assert bits < 2.4 + max(0, math.log2(max(1, (values[-1] - values[0]) / len(values))))
        assert [code[i] for i in range(0, len(values), 997)] == values[::997].tolist()
    with pytest.raises(ValueError, match="fall"):
        EliasFano.encode(np.array([2, 1]))


# Tokens.


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab'sÉ1 \n\t  <|>.", max_size=40), st.text(max_size=20), st.sampled_from(["a  b", "a   b", " a", "a ", "\n b", "x \n y", "<|endoftext|>", "a  <|endoftext|> b", "don't 's 12 !?"])), max_size=6))
def test_words_are_encoded_as_whole_texts_are(texts):
    plain = Tokenizer.from_file(TOKENIZER)
    ids, lengths = token_store.encoder(TOKENIZER).encode(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["The cat  sat.", "", None, "Übung <|endoftext|> x"]
    ids, lengths = token_store.encoder(path).encode(pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))


def token_rows():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "École", "x1", "don't", "naïve", "qux\nbar"])
    docs = [(rng.randrange(-500, 500), rng.choice(["", " ", "  "]) + " ".join(word() for _ in range(rng.randrange(40)))) for _ in range(150)]
    docs += [(7, None), (7, ""), (None, "b a"), (None, "b a"), (None, None), (900, "wörd " * 60_000), (901, "x" * 50_000), (1 << 62, "far"), (-(1 << 62), "far")] + [(33, "copy")] * 90
    return docs


def test_tokens_against_brute_force(spark, tmp_path):
    docs = token_rows()
    rng = random.Random(1)
    rng.shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("h", F.lit("clash")).withColumn("start", F.lit(1)).withColumn("ids", F.lit(1)).repartition(6)
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        files = token_store.write_tokens(d, path, TOKENIZER, most_ids=2_000, most_docs=60).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(f["documents"] for f in files) == len(docs) and len(files) >= 5
    got = token_store.read_tokens(spark, path, ids=True).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = [(i, (*plain.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in docs]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((i, x, len(x), crc(x)) for i, x in want), key=str)
    # In the order of starts the ids ascend, nulls first, and each document begins where the one before ends.
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    # A document alone, by its place or its id.
    for f in files:
        shard = token_store.Shard(f"{path}/{f['file']}")
        for i in {0, f["documents"] - 1}:
            assert (shard.document(i) == token_store.np.frombuffer(open(f"{path}/{f['file']}", "rb").read(), "<u2")[slice(*shard.bounds(i))]).all()
        for wanted in (33, 900, 12345):
            places = shard.find(wanted)
            assert all(tuple(shard.document(i).tolist()) in {x for k, x in want if k == wanted} for i in places)
    assert sum(len(token_store.Shard(f"{path}/{f['file']}").find(33)) for f in files) == sum(i == 33 for i, _ in docs)


def test_a_file_that_is_not_in_the_manifest_does_not_count(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_store.write_tokens(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), path, TOKENIZER)
    (tmp_path / "tokens" / "part-00000-left.ids").write_bytes(b"\1\2")
    (tmp_path / "tokens" / "part-00000-left.idx").write_bytes(b"")
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.read_tokens(spark, path).collect()) == [(1, 0, 3), (2, 3, 2)]


def test_tokens_of_empty_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string").where("doc_id > 1")
    assert token_store.store_round_trip(d, TOKENIZER).collect() == []


def test_the_first_cells_of_a_file_are_its_ids(spark, tmp_path):
    """The .ids file is nothing but little-endian ids, the end id behind each document."""
    path = str(tmp_path / "tokens")
    files = token_store.write_tokens(spark.createDataFrame([(2, "b"), (1, "a a")], "doc_id long, text string").coalesce(1), path, TOKENIZER).orderBy("task").collect()
    raw = b"".join((tmp_path / "tokens" / f["file"]).read_bytes() for f in files)
    plain = Tokenizer.from_file(TOKENIZER)
    assert np.frombuffer(raw, "<u2").tolist() == [*plain.encode("a a").ids, 0, *plain.encode("b").ids, 0]


# The registered queries.

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_the_queries_give_what_sql_and_brute_force_give(spark):
    db = duckdb.connect()
    for f in ("embeddings", "documents"):
        db.execute(f"create view {f} as select * from '{SF}/{f}.parquet'")
    want = db.execute(queries.SQL["op11_clusters"])
    assert [d[0] for d in want.description] == queries.op11_clusters(spark, SF).columns
    assert sorted(map(tuple, queries.op11_clusters(spark, SF).collect())) == sorted(want.fetchall())
    plain, start, rows = Tokenizer.from_file(TOKENIZER), 0, []
    for i, t in db.execute("select doc_id, text from documents order by doc_id").fetchall():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        rows.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.op12_tokens(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, got.collect())) == rows
