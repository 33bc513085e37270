"""The jobs: growing input, repeated and broken runs, edge cases, command lines, and their registered queries against SQL."""

import hashlib
import json
import os
import subprocess
import sys

import duckdb
import pytest
from jobs import common, page_feed, queries, search_report
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def pages(spark, folder, rows, name):
    """One more file in a folder of crawls, with columns that the feed ignores."""
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("batch", F.lit("clash"))
    df.coalesce(1).write.parquet(f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    for f in os.listdir(f"{folder}-{name}"):
        if f.startswith("part-"):
            os.rename(f"{folder}-{name}/{f}", f"{folder}/{name}-{f}")


def told(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["place"], r["title"], r["content"], r["batch"]) for r in df.collect()), key=str)


FIRST = [
    (1, "https://Docs.example/a?x", "<nav>menu</nav><h1>Title &amp; more</h1><p>One</p><h2>Part</h2><ul><li>x</li><li>y</li></ul>"), (2, "https://docs.example/b", "<p>old</p>"), (3, "https://other.example/c", "gone soon"),
    (None, "http://x/", "nameless"), (None, "http://x/", "nameless"), (4, None, "<!-- c --><script>x</script> plain"), (5, "no host", ""), (7, "http://twice/", "same"), (7, "http://twice/", "same"),
]
SECOND = [(2, "https://docs.example/b", "<h1>New</h1>text"), (3, "https://other.example/c", None), (6, "https://docs.example/d", "<p>" + "word " * 60_000 + "</p>"), (None, "http://y/", None)]
AFTER_FIRST = [
    (None, "x", "/", 0, "Introduction", "nameless", 0), (None, "x", "/", 0, "Introduction", "nameless", 0), (1, "docs.example", "/a", 0, "Title & more", "# Title & more\n\nOne\n", 0), (1, "docs.example", "/a", 1, "Part", "## Part\n\n- x\n\n- y", 0),
    (2, "docs.example", "/b", 0, "Introduction", "old", 0), (3, "other.example", "/c", 0, "Introduction", "gone soon", 0), (4, "", "", 0, "Introduction", "plain", 0), (5, "", "", 0, "Introduction", "", 0), (7, "twice", "/", 0, "Introduction", "same", 0),
]


def test_the_feed_takes_only_what_is_new(spark, tmp_path, caplog):
    folder, out, mark = str(tmp_path / "crawls"), str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: told(page_feed.feed(spark, folder, out, mark))
    files = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(out) for f in names if f.startswith("part-")}
    pages(spark, folder, FIRST, "one")
    first = run()
    assert first == sorted(AFTER_FIRST, key=str)
    stood = files()
    with caplog.at_level("INFO", "docmill.jobs"):
        assert run() == first
    assert "0 new rows read" in caplog.text and files() == stood
    pages(spark, folder, SECOND, "two")
    caplog.clear()
    with caplog.at_level("INFO", "docmill.jobs"):
        second = run()
    assert f"{len(SECOND)} new rows read" in caplog.text and "batch 1: 4 pages (2 removed)" in caplog.text
    want = [r for r in AFTER_FIRST if r[0] not in (2, 3)] + [(2, "docs.example", "/b", 0, "New", "# New\ntext", 1), (6, "docs.example", "/d", 0, "Introduction", ("word " * 60_000).strip(), 1)]
    assert second == sorted(want, key=str)
    assert stood.items() <= files().items()
    # A driver lost after the batch was written and before it was marked: the batch runs again, into the same folders.
    for f in ("1", ".1.crc"):
        (tmp_path / "mark" / "commits" / f).unlink(missing_ok=True)
    assert run() == second and stood.items() <= files().items() and len(files()) == len(set(files()))
    assert set(os.listdir(out)) >= {"batch=0", "batch=1"}
    bucket = "bucket=" + hashlib.md5(b"docs.example").hexdigest()[0]
    assert bucket in os.listdir(f"{out}/batch=1")


def test_batches_of_the_feed_give_the_same_pages(spark, tmp_path):
    folder = str(tmp_path / "crawls")
    pages(spark, folder, FIRST, "one")
    pages(spark, folder, SECOND, "two")
    os.utime(next(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("two")), (4e9, 4e9))
    one = told(page_feed.feed(spark, folder, str(tmp_path / "a"), str(tmp_path / "am")))
    each = told(page_feed.feed(spark, folder, str(tmp_path / "b"), str(tmp_path / "bm"), files_per_batch=1))
    assert [r[:6] for r in one] == [r[:6] for r in each] and {r[6] for r in one} == {0} and {r[6] for r in each} == {0, 1}


def test_a_feed_without_pages(spark, tmp_path):
    folder = str(tmp_path / "crawls")
    pages(spark, folder, [], "none")
    assert page_feed.feed(spark, folder, str(tmp_path / "out"), str(tmp_path / "mark")).collect() == []


def test_the_report_of_known_items(spark, tmp_path):
    rows = [(i, f"alpha{i} beta{i % 7} the shared words", f"s{i % 3}" if i % 4 else None) for i in range(120)]
    rows += [(150, rows[100][1], "copy"), (200, None, "s0"), (250, "", "s1"), (300, "the and of", "s2"), (None, "alpha50", "s0"), (350, "solo " * 50_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("term", F.lit("clash")).withColumn("id", F.lit("clash")).repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    run = lambda: sorted(map(tuple, search_report.report(spark, str(tmp_path / "docs"), str(tmp_path / "out"), terms=2, k=5).collect()))
    got = run()
    assert run() == got
    by_id = {r[0]: r for r in got}
    assert set(by_id) == {0, 50, 100, 150, 200, 250, 300, 350}
    assert by_id[50][1:5] == ("alpha50 beta1", 2, 1, 1.0) and by_id[50][9] == "s2" and by_id[0][9] is None
    assert by_id[100][3] == 1 and by_id[150][3:5] == (2, 0.5) and by_id[150][6] == 100  # equal texts: the smaller id stands first
    assert [by_id[i][1:4] + by_id[i][8:9] for i in (200, 250, 300)] == [("", 0, None, 0)] * 3 and by_id[350][1:4] == ("solo", 1, 1)
    assert {"source=copy", "source=__HIVE_DEFAULT_PARTITION__"} <= set(os.listdir(tmp_path / "out"))
    docs.limit(0).write.parquet(str(tmp_path / "empty"))
    assert search_report.report(spark, str(tmp_path / "empty"), str(tmp_path / "none")).collect() == []


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"k": 3}))
    assert common.settings(spark, str(tmp_path / "c.json"), {"k": 10, "every": 50}) == {"k": 3, "every": 50}
    (tmp_path / "c.json").write_text(json.dumps({"kk": 3}))
    with pytest.raises(ValueError, match="kk"):
        common.settings(spark, str(tmp_path / "c.json"), {"k": 10})
    for name in ("page_feed", "search_report"):
        module = sys.modules[f"jobs.{name}"]
        assert set(json.loads(open(os.path.join(os.path.dirname(module.__file__), f"{name}.json")).read())) == set(module.SETTINGS)


def test_a_command_line(spark, tmp_path):
    folder = str(tmp_path / "crawls")
    pages(spark, folder, FIRST, "one")
    (tmp_path / "c.json").write_text(json.dumps({"pages": folder, "out": "elsewhere", "checkpoint": str(tmp_path / "mark")}))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.session.timeZone=UTC pyspark-shell"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.page_feed", "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "out")], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "9 new rows read" in done.stderr
    assert told(page_feed.current(spark, str(tmp_path / "out"))) == sorted(AFTER_FIRST, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(queries.SQL))
def test_job_gives_what_its_sql_gives(spark, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = db.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    show = lambda rows: sorted(str([f"{v:.6f}" if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(got.select(sorted(columns)).collect()) == show([[r[columns.index(c)] for c in sorted(columns)] for r in want.fetchall()])
    assert before == {k: spark.conf.get(k, None) for k in before}
