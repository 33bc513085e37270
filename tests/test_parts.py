"""Work that is dear by the row is dealt to all cores, and done once a row."""

from docmill import queries
from docmill.functions.schema import as_chunks
from docmill.operators.chunking import pycode


def test_parts_are_dealt_to_all_cores_however_few_row_groups_hold_them(spark, tmp_path):
    spark.range(400).selectExpr("id p_partkey", "'p ' || id p_name", "'t' p_type", "'b' p_brand", "1 p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("front_matter_fields", "component_documents", "python_files", "python_symbols"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        if name != "python_symbols":  # its modules are written before
            tasks = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
            assert sum(n > 0 for n in tasks) >= spark.sparkContext.defaultParallelism, name
        assert df.count() == {"front_matter_fields": 400, "component_documents": 1200, "python_files": 400, "python_symbols": 1600}[name]


def test_a_module_is_parsed_once(spark):
    rows = as_chunks(spark.createDataFrame([("s", "m/a.py", '"""Doc."""\nclass A:\n    def f(self): ...\n')], "source_id string, path string, content string")).select("source_id", "path", "content", "is_entrypoint").selectExpr("*", "cast(null as timestamp_ntz) modified")
    for strategy in ("symbol", "module"):
        found = pycode.chunk_python(rows, strategy)
        assert found.count() == {"symbol": 3, "module": 2}[strategy]
        assert "parsed" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = pycode.chunk_python(rows.repartition(3), "file")._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("parsed(") == 1 and whole.index("parsed(") < whole.index("Repartition")
