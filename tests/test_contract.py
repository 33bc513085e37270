import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(__spark_entry__._core.SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    show = lambda rows: sorted(str([f"{v:.6f}" if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(got.select(sorted(columns)).collect()) == show([[r[columns.index(c)] for c in sorted(columns)] for r in want.fetchall()])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
