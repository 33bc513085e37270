"""Folders are listed, and files read, by tasks; the driver's file index holds none of them."""

import os
import random

import pytest

from docmill.plans import changes, indexing
from docmill.plans.shared import release, shared_dir
from docmill.queries import QUERIES
from docmill.sources import files, store
from docmill.sources.config import Adapter, Source


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    for folder in ("", "a", "a/b", "a/b/c", "d e", "_out", ".git", "_k=1"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for name in ("x.md", "y.MD", "_own.md", ".z.md", "[odd].md", "w.txt"):
            (root / folder / name).write_text(f"# {folder}/{name}\n")
    (root / "a" / "latin.md").write_bytes(b"\xe9t\xe9")
    os.symlink(root / "a" / "nothing", root / "a" / "broken.md")
    return str(root)


def listed_by_spark(spark, root):
    base = files.qualified(spark, root)
    return {(r["path"][len(base) + 1 :], r["length"], r["modificationTime"]) for r in files.opened(spark, [base]).select("path", "length", "modificationTime").collect()}


@pytest.mark.parametrize("entries", [1, 10_000])
def test_tasks_list_what_spark_lists(spark, tree, monkeypatch, entries):
    monkeypatch.setattr(files, "ENTRIES", entries)
    os.unlink(f"{tree}/a/broken.md")
    want = listed_by_spark(spark, tree)
    rows = files.listing(spark, tree, ["**/*"])
    assert "content" not in rows.columns
    assert {(r["path"], r["length"], r["modified"]) for r in rows.collect()} == want and len(want) == 6 * 4 + 1


def test_scans_and_changes_do_without_the_drivers_file_index(spark, tree, monkeypatch):
    def opened(*_):
        raise AssertionError("the driver lists files")

    monkeypatch.setattr(files, "opened", opened)
    rows = files.scan(spark, tree, ["**/*.md"], ["a/b/*"], "docs", ["x.md"], latin=False, extensions=["md"]).collect()
    got = {r["path"]: (r["content"], r["error"], r["is_entrypoint"]) for r in rows}
    assert got.pop("a/latin.md") == (None, "not UTF-8", False)
    assert got == {f"{f}{n}": (f"# {f or '/'}{n}\n", None, f + n == "x.md") for f in ("", "a/", "d e/", "_k=1/") for n in ("x.md", "[odd].md")}
    source = Source("docs", tree, adapters=[Adapter("component"), Adapter("markdown")])
    assert indexing.index_source(spark, source).count() == 2 * len(files.listing(spark, tree, source.include_globs).collect()) - 2
    found = changes.changes(spark, [source], spark.createDataFrame([], changes.FILES))
    assert {r["change"] for r in found.collect()} == {"added"} and found.where("digest is null").count() == 0
    assert {r["change"] for r in changes.changes(spark, [source], changes.manifest_of(found)).collect()} == {"kept"}


def test_contents_of_files_are_numbered_without_a_shuffle(spark, tmp_path):
    r = random.Random(3)
    for i in range(90):
        at = tmp_path / "docs" / f"f{r.randrange(7)}" / f"n{i}.md"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"# {i}\n{r.randbytes(10_000).hex()}\n" + "".join(f"## Part {p}\n" for p in range(i % 4)))
    source = Source("docs", str(tmp_path / "docs"), adapters=[Adapter("component"), Adapter("markdown")])
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    chunks = indexing.index_source(spark, source, 5)
    store.save_chunks(chunks, str(tmp_path / "store"))
    release(chunks)
    assert shuffled() - before < 300_000  # the listing's; the contents of the two adapters have 3.6 MB
    rows = sorted((x["seq"], x["chunk_class"], x["path"], x["title"], x["content"]) for x in store.load_chunks(spark, str(tmp_path / "store")).collect())
    assert [x[0] for x in rows] == list(range(5, 5 + len(rows)))
    at = lambda x: -1 if x[3].isdigit() else int(x[3].split()[1])
    assert [x[1:] for x in rows] == [x[1:] for x in sorted(rows, key=lambda x: (x[1], x[2], at(x)))] and len(rows) == 2 * sum(1 + i % 4 for i in range(90))
    assert not os.path.exists(chunks._written_at.removeprefix("file:"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["indexed_chunks", "indexed_latest", "store_metadata"])
def test_files_and_unnumbered_chunks_are_gone_once_chunks_are_stored(spark, name):
    left = lambda: {os.path.join(d, f) for d, _, names in os.walk(shared_dir(spark)) for f in names if "docmill-document-files-" in d or "docmill-chunks-" in d}
    before = left()
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert left() == before
