"""Coded vectors: recall and what is read on the real table, exact scores, filters and edge cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import coded, knn

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_recall_and_share_read_on_the_real_table(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    coded.save_codes(v, str(tmp_path / "codes"))
    codes = spark.read.parquet(str(tmp_path / "codes"))
    seen = []
    looked_up = coded.looked_up
    coded.looked_up = lambda chunks, hits: (seen.append(hits.count()), looked_up(chunks, hits))[1]
    try:
        found = coded.nearest_coded(codes, v, q, 10).collect()
    finally:
        coded.looked_up = looked_up
    want = {(r["query_id"], r["id"]): r["score"] for r in knn.nearest(v, q, 10).collect()}
    got = {(r["query_id"], r["id"]): r["score"] for r in found}
    n, queries = v.count(), q.count()
    share = codes.agg(F.sum(F.octet_length("code") + 4)).first()[0] / (n * 64 * 4) + seen[0] / queries / n
    recall = len(want.keys() & got.keys()) / len(want)
    print(f"recall@10: {recall:.4f} of {len(want)}; bytes read for a query: {share:.3f} of all")
    assert recall >= 0.9 and share <= 0.2
    assert all(abs(got[x] - want[x]) < 2e-6 for x in want.keys() & got.keys())


def test_coded_against_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 7))
    x[10] = x[11] = x[12]
    x[20] = 0
    rows = [(i, [float(a) for a in r], f"s{i % 3}") for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>, source_id string")
    odd = v.unionByName(spark.createDataFrame([(500, None, "s0"), (501, [float("nan")] * 7, "s0"), (502, [float("inf")] + [1.0] * 6, "s1")], v.schema))
    q = spark.createDataFrame([(1, [float(a) for a in x[12]], None), (2, [float(a) for a in x[5]], "s1"), (3, [0.0] * 7, None)], "query_id int, embedding array<double>, source string")
    codes = coded.codes_of(odd)
    show = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect() if r["query_id"] != 3)
    assert show(coded.nearest_coded(codes, odd, q, 7)) == show(knn.nearest(v, q, 7))
    assert {r["score"] for r in coded.nearest_coded(codes, odd, q, 7).where("query_id = 3").collect()} == {0.0}
    assert coded.nearest_coded(codes, odd, q.limit(0), 3).count() == 0 and coded.nearest_coded(codes.limit(0), odd, q, 3).count() == 0
    assert {r["id"] for r in codes.where("code is null").collect()} == {500, 501, 502}
