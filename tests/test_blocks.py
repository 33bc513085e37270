"""A stored index holds postings in blocks: a term once for many chunks, a chunk's id once; and what it gives is what rows of postings give."""

import json
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docmill.functions.schema import as_chunks
from docmill.operators import lexical
from docmill.operators.knn import hashing_provider
from docmill.plans import shared, stored
from docmill.sources import store

TEXTS = ["b a b_a b é A", "", None, "running runs run the", "x " * 20 + "the y", "  ", "the 1 of"]


def chunk_rows(spark, texts, parts=1):
    rows = [(f"i{k}", "s" if k % 3 else None, k, "T é" if k % 2 else "", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, source_id string, seq long, title string, content string").repartition(parts)


def rows_of(index, positions):
    return sorted((r["id"], r["source_id"] or "", r["seq"], r["n"], r["term"], r["tf"], r["at"] if positions else None) for r in index.postings.collect())


@pytest.mark.parametrize("size,rows", [(1, 1), (1, 3), (200, 2), (1 << 20, 50_000)])
@pytest.mark.parametrize("positions", [False, True])
@pytest.mark.parametrize("analyzer", ["plain", "porter"])
def test_blocks_give_the_same_postings(spark, monkeypatch, tmp_path, size, rows, positions, analyzer):
    plain = chunk_rows(spark, TEXTS)
    want = lexical.build_lexical(plain, analyzer, ("title", "content"), positions=positions)
    monkeypatch.setattr(store, "SMALL", 0 if size > 1 else 1000)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", size)
    monkeypatch.setattr(lexical, "ROWS", rows)
    monkeypatch.setattr(lexical, "BLOCK_ROW", rows)
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 3)
    made = lexical.build_lexical(chunk_rows(spark, TEXTS, 2), analyzer, ("title", "content"), positions=positions, stored=True)
    store.save_lexical(made, str(tmp_path / "made"))
    store.save_lexical(want, str(tmp_path / "rows"))
    for index in (made, store.load_lexical(spark, str(tmp_path / "made")), store.load_lexical(spark, str(tmp_path / "rows"))):
        assert rows_of(index, positions) == rows_of(want, positions)
        assert {tuple(r) for r in index.terms.collect()} == {tuple(r) for r in want.terms.collect()}
        assert (index.chunks, index.mean, index.analyzer) == (want.chunks, pytest.approx(want.mean), analyzer)


def test_blocks_of_tfidf_and_of_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SMALL", -1)
    for k, texts in enumerate((TEXTS, ["", None, "the of"], [])):
        chunks = chunk_rows(spark, texts) if texts else chunk_rows(spark, ["a"]).limit(0)
        want, path = lexical.build_tfidf(chunks), str(tmp_path / str(k))
        store.save_lexical(lexical.build_tfidf(chunks, stored=True), path)
        got = store.load_lexical(spark, path)
        assert rows_of(got, False) == rows_of(want, False) and sorted(got.terms.collect()) == sorted(want.terms.collect()) and got.chunks == want.chunks


def test_an_index_of_rows_that_a_former_version_stored_is_read(spark, tmp_path):
    index = lexical.build_lexical(chunk_rows(spark, TEXTS), fields=("content",))
    index.postings.select("id", "source_id", "seq", "n", "term", "tf").write.parquet(str(tmp_path / "postings"))
    index.terms.write.parquet(str(tmp_path / "terms"))
    (tmp_path / "statistics.json").write_text(json.dumps({"chunks": index.chunks, "mean": index.mean, "analyzer": "plain", "positions": False}))
    assert rows_of(store.load_lexical(spark, str(tmp_path)), False) == rows_of(index, False)


def bytes_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_a_stored_index_is_written_once_and_small(spark, tmp_path, monkeypatch):
    """Before, each posting was shuffled and stored with its chunk's id, and chunks were written twice."""
    r = random.Random(1)
    texts = [" ".join(f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(120)) for _ in range(1500)]
    rows = [(f"{r.getrandbits(64):016x}", "s", f"p{k}", t, "component", "s", k % 1400) for k, t in enumerate(texts)]
    chunks = as_chunks(spark.createDataFrame(rows, "id string, source_id string, path string, content string, chunk_class string, component_name string, seq long"))
    again = chunks.limit(20).withColumn("seq", F.col("seq") + 5000).withColumn("content", F.lit("w1 again"))
    chunks, names = chunks.unionByName(again), []
    monkeypatch.setattr(shared, "shared_path", lambda s, name, made=shared.shared_path: names.append(name) or made(s, name))
    stored.build(chunks, str(tmp_path), hashing_provider(8), "plain")
    assert "latest-chunks" not in names and "vectors" not in names
    monkeypatch.undo()
    found = stored.load(spark, str(tmp_path), hashing_provider(8)).hybrid
    want = lexical.build_lexical(lexical.latest(chunks), positions=True)
    assert rows_of(found.lexical, True) == rows_of(want, True) and found.lexical.chunks == 1500
    assert sorted(found.chunks.collect(), key=lambda c: c["id"]) == sorted(lexical.latest(chunks).collect(), key=lambda c: c["id"]) and found.vectors.count() == 1500
    at = f"{tmp_path}/index/{stored.current(spark, str(tmp_path))['version']}/0"
    table = pq.read_table(f"{at}/lexical/postings")
    assert "id" not in table.column_names and table.num_rows < want.postings.count() / 2
    ranges = sorted((ids[0], ids[-1]) for f in os.listdir(f"{at}/chunks") if f.endswith(".parquet") for ids in [pq.read_table(f"{at}/chunks/{f}", columns=["id"])["id"].to_pylist()] if ids and ids == sorted(ids))
    assert sum(len(pq.read_table(f"{at}/chunks/{f}", columns=["id"])) for f in os.listdir(f"{at}/chunks") if f.endswith(".parquet")) == 1500 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    want.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(str(tmp_path / "rows"))
    assert bytes_of(f"{at}/lexical") < bytes_of(tmp_path / "rows") * 3 / 4
