"""An index in segments against one built anew, what a reload reads, embeds and writes, and what is left after a lost driver."""

import os

import pytest
from pyspark.sql import functions as F

from docmill.functions.schema import as_chunks
from docmill.operators import knn, lexical, segments
from docmill.plans import changes, stored
from docmill.plans.tools import Engine
from docmill.sources import store
from docmill.sources.config import Adapter, Source


def files_below(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def counting_provider(folder):
    """A provider that notes each text that executors send it."""
    plain = knn.hashing_provider(16)

    def embed(texts):
        with open(f"{folder}/asked", "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return plain(texts)

    embed.name, embed.dim = "counting", 16
    return embed


@pytest.fixture
def docs(tmp_path):
    d = tmp_path / "docs"
    (d / "ui").mkdir(parents=True)
    (d / "guide").mkdir()
    for i in range(6):
        (d / "guide" / f"g{i}.md").write_text(f"# Guide {i}\nalpha{i} shared words here\n## Part\nbeta get_user")
    (d / "ui" / "button.md").write_text("---\ncomponent: Button\ncategory: Forms\nuses: [Spinner]\n---\n# Button\nA button.\n")
    (d / "ui" / "[odd].md").write_text("---\ncomponent: Odd\ncategory: Forms\n---\n# Odd\nOdd name.\n")
    sources = [Source("guide", str(d / "guide")), Source("ui", str(d / "ui"), adapters=[Adapter("component")])]
    return d, sources


def engine_of(spark, sources, path, provider):
    from docmill.plans.indexing import index_sources

    store.save_chunks(index_sources(spark, sources), path)
    e = Engine(store.load_chunks(spark, path), sources, provider, path=path)
    e.save()
    return e


def same_as_new(spark, engine, provider):
    """All that the engine answers is what one built from its chunks answers."""
    anew = Engine(store.load_chunks(spark, engine.path), engine.sources, provider)
    opened = Engine.open(spark, engine.path, engine.sources, provider)
    rows = lambda df: sorted(str([f"{v:.9f}" if isinstance(v, float) else v for v in r]) for r in df.collect())
    for ask in ("get_user", "fresh gamma"):
        assert rows(opened.search(ask)) == rows(anew.search(ask)), ask
    assert rows(opened.search_components("odd button")) == rows(anew.search_components("odd button"))
    assert rows(opened.index.lexical.terms) == rows(anew.index.lexical.terms) and rows(opened.tfidf.terms) == rows(anew.tfidf.terms)
    assert (opened.index.lexical.chunks, opened.index.lexical.mean) == (anew.index.lexical.chunks, pytest.approx(anew.index.lexical.mean))
    assert rows(opened.index.lexical.postings.select("id", "term", "tf", "n", "at")) == rows(anew.index.lexical.postings.select("id", "term", "tf", "n", "at"))
    assert rows(opened.list_component_categories()) == rows(anew.list_component_categories())
    assert rows(opened.index.vectors.select("id", "embedding")) == rows(anew.index.vectors.select("id", "embedding"))


def test_reload_takes_what_has_changed(spark, docs, tmp_path):
    d, sources = docs
    provider = counting_provider(tmp_path)
    asked = lambda: open(tmp_path / "asked").read().splitlines()
    e = engine_of(spark, sources, str(tmp_path / "store"), provider)
    first, stood, version = len(asked()), files_below(f"{e.path}/index"), stored.current(spark, e.path)["version"]
    assert {r["source_id"]: r["chunk_count"] for r in e.reload().collect()} == {"guide": 12, "ui": 2}
    assert files_below(f"{e.path}/index") == stood  # nothing has changed
    # Changed, added, removed, touched without a change, and moved: the moved file's texts are known.
    (d / "guide" / "g1.md").write_text("# Guide 1\nfresh gamma\n## Part\nbeta get_user")
    (d / "guide" / "g6.md").write_text("# Guide 6\nalpha6 get user")
    (d / "guide" / "g2.md").unlink()
    os.utime(d / "guide" / "g3.md", (2e9, 2e9))
    os.rename(d / "guide" / "g4.md", d / "guide" / "h4.md")
    (d / "ui" / "[odd].md").write_text("---\ncomponent: Odd\ncategory: Feedback\n---\n# Odd\nOdd no more.\n")
    before = len(asked())
    found = changes.changes(spark, sources, stored.manifest(spark, e.path))
    assert {(r["path"], r["change"]) for r in found.where("change <> 'kept'").collect()} == {("g1.md", "changed"), ("g6.md", "added"), ("g2.md", "removed"), ("g4.md", "removed"), ("h4.md", "added"), ("[odd].md", "changed")}
    got = {r["source_id"]: r["chunk_count"] for r in e.reload().collect()}
    assert got == {"guide": 11, "ui": 2} and first == before == 14
    new = asked()[before:]
    assert sorted(t.split("  ")[0] for t in new) == ["Guide 1", "Guide 6", "Odd"], new
    told = stored.current(spark, e.path)
    assert told["version"] == version and told["segment"] == 1 and stood.items() <= files_below(f"{e.path}/index").items()
    assert sum(spark.read.parquet(f"{e.path}/index/{version}/1/lexical/postings").groupBy("id").count().count() for _ in (1,)) == 6
    same_as_new(spark, e, provider)
    # One source alone, the same file again; then a source without files.
    (d / "guide" / "g1.md").write_text("# Guide 1\nalpha1 once more")
    (d / "ui" / "button.md").write_text("---\ncomponent: Button\ncategory: Forms\n---\n# Button\nnot yet seen\n")
    assert {r["source_id"]: r["chunk_count"] for r in e.reload("guide").collect()} == {"guide": 10}
    assert e.search("yet seen").where(F.col("snippet").contains("yet seen")).count() == 0
    for f in ("button.md", "[odd].md"):
        (d / "ui" / f).unlink()
    assert e.reload().collect() == [("guide", 10)] and stored.current(spark, e.path)["segment"] == 3
    same_as_new(spark, e, provider)


def test_clear_takes_one_source_out(spark, docs, tmp_path):
    _, sources = docs
    provider = knn.hashing_provider(16)
    e = engine_of(spark, sources, str(tmp_path / "store"), provider)
    assert e.clear("nothing") == 0 and e.clear("guide") == 12
    assert {r["source_id"]: r["chunk_count"] for r in e.list_sources().select(F.col("id").alias("source_id"), "chunk_count").collect()} == {"guide": 0, "ui": 2}
    opened = Engine.open(spark, e.path, sources, provider)
    assert opened.search("shared words").where("source_id = 'guide'").count() == 0 and opened.index.lexical.chunks == 2 and opened.index.lexical.terms.where("term = 'alpha1'").count() == 0
    assert {r["source_id"]: r["chunk_count"] for r in opened.reload("guide").collect()} == {"guide": 12} and opened.search("alpha1").first()["path"] == "g1.md"


def test_a_lost_driver_leaves_the_index_whole(spark, docs, tmp_path, monkeypatch):
    d, sources = docs
    provider = knn.hashing_provider(16)
    e = engine_of(spark, sources, str(tmp_path / "store"), provider)
    (d / "guide" / "g1.md").write_text("# Guide 1\nfresh gamma")
    with monkeypatch.context() as m:
        m.setattr(stored, "_point", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            e.reload()
    opened = Engine.open(spark, e.path, sources, provider)
    assert opened.search("gamma").where("lexical_rank is not null").count() == 0 and opened.search("alpha1").where("lexical_rank is not null").count() > 0
    opened.reload()
    same_as_new(spark, opened, provider)


def test_many_segments_become_a_new_version(spark, docs, tmp_path, monkeypatch):
    d, sources = docs
    monkeypatch.setattr(stored, "MOST_SEGMENTS", 1)
    e = engine_of(spark, sources, str(tmp_path / "store"), knn.hashing_provider(16))
    seen = []
    for i in range(2):
        (d / "guide" / "g1.md").write_text(f"# Guide 1\nfresh gamma{i}")
        e.reload()
        told = stored.current(spark, e.path)
        seen.append((told["version"], told["segment"]))
    assert [s for _, s in seen] == [1, 0] and seen[0][0] != seen[1][0]
    assert e.search("gamma1").first()["path"] == "g1.md"


def test_segments_with_nothing_new_or_nothing_dead(spark):
    chunks = lambda *rows: as_chunks(spark.createDataFrame([(i, "s", "p", "", c, k) for k, (i, c) in enumerate(rows)], "id string, source_id string, path string, title string, content string, seq long"))
    one, two, none = (lexical.build_lexical(c, fields=("content",)) for c in (chunks(("a", "x y"), ("b", "x"), ("c", "")), chunks(("d", "x z z")), chunks(("a", "")).limit(0)))
    dead = spark.createDataFrame([("b", 0)], "id string, segment int")
    terms = lambda i: {r["term"]: r["df"] for r in i.terms.collect()}
    both = segments.merged([one, two], None, segments.Counts(4, 6))
    assert terms(both) == {"x": 3, "y": 1, "z": 1} and both.mean == 1.5
    some = segments.merged([one, none, two], dead, segments.Counts(3, 5))
    assert terms(some) == {"x": 2, "y": 1, "z": 1} and {r["id"] for r in some.postings.collect()} == {"a", "d"}
    assert terms(segments.merged([one, none], spark.createDataFrame([("a", 0), ("b", 0)], "id string, segment int"), segments.Counts(1, 0))) == {}


def test_a_stream_merges_into_the_stored_index_once(spark, tmp_path, monkeypatch):
    from docmill.streaming.ingest import follow, merge_index

    root, path, check = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "check")
    root.mkdir()
    (root / "a.md").write_text("# One\nalpha words")
    (root / "b.md").write_bytes(b"# Bad \xff")
    run = lambda: follow(spark, str(root), "s", "markdown", path, check, index="docs").awaitTermination()
    rows = lambda: sorted((r["path"], r["title"]) for r in stored.load(spark, path, knn.hashing_provider()).hybrid.chunks.collect())
    run()
    assert rows() == [("a.md", "One")] and stored.current(spark, path)["marks"] == {"docs": 0}
    (root / "c.md").write_text("# Two\nbeta\n# Three")
    with monkeypatch.context() as m:  # the driver is lost before the pointer is replaced
        m.setattr(stored, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    assert rows() == [("a.md", "One")]
    run()
    want = [("a.md", "One"), ("c.md", "Three"), ("c.md", "Two")]
    told = stored.current(spark, path)
    assert rows() == want and told["marks"] == {"docs": 1} and told["segment"] == 1
    again = spark.createDataFrame([("s", "c.md", "# Two\nbeta\n# Three", False)], "source_id string, path string, content string, is_entrypoint boolean").withColumn("modified", F.current_timestamp().cast("timestamp_ntz"))
    merge_index(path, "markdown", "docs")(again, 1)  # a batch that comes again
    assert stored.current(spark, path) == told
    merge_index(path, "markdown", "docs")(again.withColumn("content", F.lit("# New")), 2)
    assert rows() == [("a.md", "One"), ("c.md", "New")]
    index = stored.load(spark, path, knn.hashing_provider()).hybrid.lexical
    assert {r["term"] for r in index.terms.collect()} >= {"alpha", "new"} and index.terms.where("term = 'beta'").count() == 0 and index.chunks == 2
    monkeypatch.setattr(stored, "MOST_SEGMENTS", 1)
    merge_index(path, "markdown", "docs")(again.withColumns({"content": F.lit("# Last"), "path": F.lit("d.md")}), 3)
    told = stored.current(spark, path)
    assert rows() == [("a.md", "One"), ("c.md", "New"), ("d.md", "Last")] and told["segment"] == 0 and told["marks"] == {"docs": 3}
