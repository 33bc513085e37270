import io
import json

import pytest
from pyspark.sql import functions as F

from docmill import cli, server
from docmill.functions.schema import as_chunks
from docmill.operators import graph, knn, lexical
from docmill.plans import stored
from docmill.plans.indexing import index_source
from docmill.plans.tools import Engine, contexts
from docmill.sources import files, store
from docmill.sources.config import Adapter, Source, adapters_of, load_sources
from docmill.streaming.ingest import follow, forget_missing

BUTTON = "---\ncomponent: Button\ncategory: Forms\nuses: [Spinner]\nrelated: [Link]\n---\n# Button\nA button runs an action.\n## Props\nsize: string\n"
ICON = "---\ncomponent: IconButton\ncategory: Forms\nextends: Button\nrelated: [Button]\n---\n# IconButton\nA button with an icon.\n"
MODAL = "---\ncomponent: Modal\ncategory: Feedback\nuses: [Button]\n---\n# Modal\nA dialog over the page.\n"
TS = "@Component({ selector: 'app-panel' })\nexport class PanelComponent {}\n"
HTML = "<div><app-panel></app-panel> panel</div>"


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    for path, content in {"ui/button.mdx": BUTTON, "ui/icon.mdx": ICON, "ui/modal.mdx": MODAL, "ui/drafts/old.mdx": BUTTON, "app/panel.component.ts": TS, "app/panel.component.html": HTML, "app/run.py": '"""Runs."""\ndef go(): ...\n', "app/latin.py": "x = '\xe9'", "guide/one.md": "# One\nfirst\n## Two\nsecond"}.items():
        (d / path).parent.mkdir(parents=True, exist_ok=True)
        (d / path).write_bytes(content.encode("latin-1" if "latin" in path else "utf-8"))
    (d / "sources.yaml").write_text(
        f"sources:\n- id: ui\n  root: {d}/ui\n  include_globs: ['**/*.mdx']\n  exclude_globs: ['drafts/*']\n  entrypoints: [button.mdx]\n  adapters: [component]\n- id: app\n  root: {d}/app\n  include_globs: ['**/*']\n  adapters: [source, {{type: python, config: {{chunk_strategy: file}}}}, nope]\n- id: guide\n  root: {d}/guide\n"
    )
    return str(d / "sources.yaml")


@pytest.fixture(scope="module")
def engine(spark, config, tmp_path_factory):
    return Engine.from_config(spark, config, str(tmp_path_factory.mktemp("store")))


def test_sources_and_counts(engine):
    got = {r["id"]: r["chunk_count"] for r in engine.list_sources().collect()}
    # Two equal ids, one of the entry and one of an overview, are one chunk; the first section of a document with front matter can be empty.
    assert got["guide"] == 2 and got["ui"] >= 4 and got["app"] == 6


def test_search(engine):
    rows = engine.search("btn", top_k=3).collect()
    assert rows and rows[0]["rank"] == 1 and rows[0]["source_id"] == "ui"
    assert {r["source_id"] for r in engine.search("button", source="guide").collect()} <= {"guide"}
    assert engine.search("  ").count() == 0


def test_context(engine):
    assert engine.get_context("guide", "one.md").first()["content"] == "# One\nfirst\n\n## Two\nsecond"
    assert engine.get_context("guide", "one.md", "two").first()["content"] == "## Two\nsecond"
    assert engine.get_context("guide", "one.md", "absent").first()["content"].startswith("# One")
    assert "No content" in engine.get_context("guide", "none.md").first()["content"]


def test_context_is_in_corpus_order_and_later_adapters_win(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Zeta\n1\n## Beta\n2\n# Alpha\n3\n## Omega\n4\n## Beta\n5")
    (tmp_path / "B.md").write_text("# First\nx")
    source = Source("s", str(tmp_path), adapters=[Adapter("component"), Adapter("markdown")])
    rows = index_source(spark, source)
    got = [(r["seq"], r["path"], r["title"], r["chunk_class"]) for r in rows.orderBy("seq").collect()]
    titles = ["Zeta", "Beta", "Alpha", "Omega", "Beta"]
    want = [(p, t, c) for c in ("component", "normalized") for p, ts in (("B.md", ["First"]), ("a.md", titles)) for t in ts]
    assert got == [(i, *w) for i, w in enumerate(want)]
    assert {r["chunk_class"] for r in lexical.latest(rows).collect()} == {"normalized"}
    plain = index_source(spark, Source("s", str(tmp_path)), first=100)
    assert [r["seq"] for r in plain.orderBy("seq").collect()] == list(range(100, 106))
    text = contexts(plain, spark.createDataFrame([("s", "a.md", None), ("s", "a.md", "omega"), ("s", "no.md", "x")], "source_id string, path string, anchor string"))
    found = {(r["path"], r["anchor"]): r["content"] for r in text.collect()}
    assert found["a.md", None] == "# Zeta\n1\n\n## Beta\n2\n\n# Alpha\n3\n\n## Omega\n4\n\n## Beta\n5"
    assert found["a.md", "omega"] == "## Omega\n4" and found["no.md", "x"] == "No content found for s/no.md#x"


def test_ties_of_tfidf_keep_corpus_order(spark, tmp_path):
    for name in ("z", "a", "m"):
        (tmp_path / f"{name}.md").write_text("needle here")
    (tmp_path / "other.md").write_text("something else")
    rows = index_source(spark, Source("s", str(tmp_path)))
    asked = spark.createDataFrame([(1, "needle")], "query_id int, text string")
    got = lexical.tfidf_search(lexical.build_tfidf(rows), rows, asked, 5).join(rows.select("id", "path"), "id").orderBy("rank").collect()
    assert [r["path"] for r in got] == ["a.md", "m.md", "z.md"]


def test_an_opened_engine_builds_nothing_and_gives_the_same(engine, spark, monkeypatch):
    for name in ("build_lexical", "build_tfidf"):
        monkeypatch.setattr(lexical, name, None)
    monkeypatch.setattr(graph, "build_graph", None)
    again = Engine.open(spark, engine.path, engine.sources)
    same = lambda f: f(engine).collect() == f(again).collect()
    assert same(lambda e: e.search("btn", top_k=3)) and same(lambda e: e.search_components("button dialog")) and same(lambda e: e.get_context("guide", "one.md"))
    assert same(lambda e: e.get_component_info("Button")) and same(lambda e: e.stats()) and same(lambda e: e.list_sources().orderBy("id"))
    assert again.index.vectors.first()["point_id"].count("-") == 4
    with pytest.raises(FileNotFoundError):
        Engine.open(spark, engine.path + "/nothing")
    with pytest.raises(ValueError, match="not made by"):
        Engine.open(spark, engine.path, provider=knn.hashing_provider(16)).search("button")


def test_an_empty_index_leaves_the_stored_one(engine, spark):
    before = stored.current(spark, engine.path)
    Engine(engine.chunks.limit(0), path=engine.path).save()
    assert stored.current(spark, engine.path) == before


def test_a_given_graph_takes_the_place_of_the_chunks_own(engine, spark):
    g = graph.with_nodes(engine.graph, spark.createDataFrame([("component", "Given")], "node_type string, name string"))
    assert Engine(engine.chunks, known=g).get_component_info("Given").count() == 1


def test_server(engine):
    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_context", "arguments": {"source": "guide", "path": "one.md", "anchor": "two"}}}]
    lines += [{"id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"id": 5, "method": "nope"}, {"id": 6, "method": "tools/call", "params": {"name": "search", "arguments": {"wrong": 1}}}, {"id": 7, "method": "ping"}]
    out = io.StringIO()
    server.serve(engine, [*(json.dumps(x) + "\n" for x in lines), "\n", "{"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {r["id"]: r for r in got}
    assert len(got) == 8 and len(by[2]["result"]["tools"]) == 12 and by[1]["result"]["protocolVersion"]
    assert json.loads(by[3]["result"]["content"][0]["text"]) == [{"content": "## Two\nsecond"}]
    assert by[4]["error"]["code"] == -32602 and by[5]["error"]["code"] == -32601 and by[6]["result"]["isError"] and by[None]["error"]["code"] == -32700 and by[7]["result"] == {}
    tool = next(t for t in by[2]["result"]["tools"] if t["name"] == "search")
    assert tool["inputSchema"]["required"] == ["query"] and tool["inputSchema"]["properties"]["top_k"] == {"type": "integer"}


def test_components(engine):
    info = engine.get_component_info("Button").first()
    assert (info["category"], info["uses"], info["used_by"], info["variants"]) == ("Forms", ["Spinner"], ["Modal"], ["IconButton"]) and set(info["related_to"]) == {"Link", "IconButton"}
    assert engine.get_component_info("IconButton").first()["extends"] == "Button" and engine.get_component_info("None").count() == 0
    assert {r["name"]: sorted(r["components"]) for r in engine.list_component_categories().collect()} == {"Forms": ["Button", "IconButton"], "Feedback": ["Modal"]}
    assert {r["name"] for r in engine.explore_category("Forms", True).collect()} == {"Button", "IconButton"}
    assert {(r["name"], r["distance"]) for r in engine.find_related_components("Modal", 2).collect()} == {("Button", 1), ("Spinner", 2), ("Link", 2), ("IconButton", 2)}


def test_component_search(engine):
    names = lambda **k: {r["component_name"] for r in engine.search_components("button dialog icon", **k).collect()}
    assert names(category="Feedback") == {"Modal"} and names(component="Modal", include_related=True) == {"Modal", "Button"} and names(component="IconButton") == {"IconButton"}
    assert {r["chunk_type"] for r in engine.search_components("button size", chunk_type="props").collect()} == {"props"}
    assert engine.search_components("button", chunk_type="unknown").count() > 0


def test_source_tools(engine):
    assert {r["file_type"] for r in engine.search_source("panel", language="typescript").collect()} == {"component"}
    assert {r["file_type"]: r["path"] for r in engine.get_component_source("panel").collect()} == {"component": "panel.component.ts", "template": "panel.component.html"}
    use = engine.find_component_usage("Panel").collect()
    assert [r["path"] for r in use] == ["panel.component.html"] and "<app-panel>" in use[0]["snippet"]
    assert engine.stats().first()["vectors"] == engine.chunks.count()


def test_reload_one_source_keeps_the_others(engine, spark):
    before = engine.chunks.groupBy("source_id").count().orderBy("source_id").collect()
    assert engine.reload("guide").collect()[0]["chunk_count"] == 2
    assert store.load_chunks(spark, engine.path).groupBy("source_id").agg(F.countDistinct("id").alias("count")).orderBy("source_id").collect() == before


def test_adapters_and_problems(spark, tmp_path):
    assert [(a.type, a.config) for a in adapters_of({"adapters": ["python", {"config": {"a": 1}}]})] == [("python", {}), ("markdown", {"a": 1})]
    assert [(a.type, a.config) for a in adapters_of({"adapter": "component", "default_category": "X"})] == [("component", {"default_category": "X"})]
    assert [a.type for a in adapters_of({})] == ["markdown"]
    (tmp_path / "s.yaml").write_text("sources:\n- {id: a, root: /nowhere/at/all}\n")
    with pytest.raises(ValueError, match="does not exist"):
        load_sources(spark, str(tmp_path / "s.yaml"))
    with pytest.raises(FileNotFoundError):
        load_sources(spark, str(tmp_path / "none.yaml"))


def test_globs():
    import re

    m = lambda g, p: bool(re.search(files.glob_regex(g), p))
    assert m("**/*.md", "a.md") and m("**/*.md", "x/y/a.md") and not m("*.md", "x/a.md") and m("x/?.md", "x/a.md") and m("[!a]*.md", "b.md") and not m("[!a]*.md", "a.md")
    f = lambda g, p: bool(re.search(files.fnmatch_regex(g), p))
    assert f("drafts/*", "drafts/a/b.md") and not f("drafts/*", "x/drafts/a") and f("*drafts/*", "x/drafts/a")


def test_undecodable_files_are_reported(spark, config):
    root = config.rsplit("/", 1)[0] + "/app"
    rows = {r["path"]: r["error"] for r in files.scan(spark, root, ["*.py"], latin=False).collect()}
    assert rows == {"run.py": None, "latin.py": "not UTF-8"}


def comp(spark, rows):
    kind = "id string, seq long, component_name string, component_category string, title string, extends string, uses array<string>, related_to array<string>, variants array<string>"
    return as_chunks(spark.createDataFrame(rows, kind).withColumn("chunk_class", F.lit("component")))


def test_graph_keeps_all_relations_and_the_simple_view_the_last(spark):
    chunks = comp(spark, [("1", 1, "Icon", "Forms", "t", "Base", ["Icon"], ["Base"], ["Big"]), ("2", 2, "Icon", "Other", "t", None, [], [], [])])
    g = graph.build_graph(chunks)
    kinds = lambda e: sorted(r["relation_type"] for r in e.where("src = 'component:Icon' and dst = 'component:Base'").collect())
    assert kinds(g.edges) == ["extends", "related_to"] and kinds(graph.simple(g.edges)) == ["related_to"]
    assert {r["category"] for r in graph.members(g).where("name = 'Icon'").collect()} == {"Forms", "Other"} and g.nodes.where("node_id = 'component:Icon'").first()["category"] == "Forms"
    asked = spark.createDataFrame([("Icon",)], "asked string")
    assert [r["name"] for r in graph.uses_of(g, asked).collect()] == ["Icon"] and graph.chunks_of(g, asked).count() == 2
    assert graph.variants_of(graph.build_graph(chunks, variants=True), asked).first()["name"] == "Big"
    again = graph.graph_from_json(graph.graph_json(g))
    assert sorted(map(str, again.edges.collect())) == sorted(map(str, g.edges.collect())) and again.nodes.count() == g.nodes.count()


def test_graph_grows(spark):
    g = graph.build_graph(comp(spark, [("1", 1, "A", "X", "t", None, [], [], [])]))
    g = graph.with_nodes(g, spark.createDataFrame([("category", "Sub", "X", "small"), ("component", "A", None, "an a"), ("category", "Y", "Z", None)], "node_type string, name string, parent_category string, description string"))
    g = graph.with_edges(g, spark.createDataFrame([("component:A", "component:New", "related_to")], "src string, dst string, relation_type string"), both_ways=True)
    by = {r["node_id"]: r for r in g.nodes.collect()}
    assert by["category:Sub"]["parent_category"] == "X" and by["component:A"]["description"] == "an a" and by["component:A"]["category"] == "X" and "category:Z" in by and graph.size(g) == len(by) == 6
    assert {r["node_id"]: r["present"] for r in graph.contains(g, spark.createDataFrame([("component:A",), ("component:Q",)], "node_id string")).collect()} == {"component:A": True, "component:Q": False}
    assert g.edges.where("relation_type = 'related_to'").count() == 2
    assert {(r["src"], r["dst"]) for r in g.edges.where("relation_type = 'belongs_to'").collect()} == {("component:A", "category:X"), ("category:Sub", "category:X"), ("category:Y", "category:Z")}


def test_graph_of_sources(spark):
    rows = spark.createDataFrame([("a", 1, "p.component.ts", "Panel", "component", "source", []), ("b", 2, "p.component.html", "Panel", "template", "source", ["Panel", "Unknown"])], "id string, seq long, path string, component_name string, file_type string, chunk_class string, component_refs array<string>")
    edges = {(r["src"], r["dst"], r["relation_type"]) for r in graph.build_graph(as_chunks(rows), sources=True).edges.collect()}
    assert edges == {("component:Panel", "source:p.component.ts", "has_source"), ("component:Panel", "source:p.component.html", "has_template"), ("source:p.component.html", "component:Panel", "references")}


@pytest.mark.parametrize("mode, depth", [("shortest", 1), ("shortest", 3), ("walk", 2), ("walk", 3)])
def test_walk_against_brute_force(spark, mode, depth):
    rows = [("1", 1, "A", "X", "t", None, ["B"], [], []), ("2", 2, "B", "X", "t", None, ["C"], [], []), ("3", 3, "C", "", "t", None, ["D"], [], []), ("4", 4, "Z", "Y", "t", None, [], [], [])]
    g = graph.build_graph(comp(spark, rows))
    near = {}
    for r in g.edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    want, front = {}, {"component:A"}
    for hop in range(1, depth + 1):
        front = {b for a in front for b in near[a]}
        for n in front - {"component:A"}:
            want[n] = hop if mode == "walk" else want.get(n, hop)
    got = {r["name"]: r["distance"] for r in graph.walk(g, spark.createDataFrame([("A",), ("None",)], "asked string"), depth, mode).collect()}
    assert got == {n.split(":")[1]: d for n, d in want.items() if n.startswith("component:")}


def test_vectors_merge_by_id(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    old.write.parquet(str(tmp_path / "v"))
    got = {r["id"]: r["v"] for r in store.upsert_vectors(spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"), str(tmp_path / "v")).collect()}
    assert got == {"a": 1, "b": 3, "c": 4}


def test_store_and_command_line(spark, config, tmp_path, capfd):
    path = str(tmp_path / "s")
    assert not store.metadata(spark, path).first()["present"] and store.load_graph(spark, path) is None
    assert cli.main(["--config", config, "--store", path, "index"]) == 0 and cli.main(["--config", config, "--store", path, "index", "--source", "guide"]) == 0
    assert store.load_chunks(spark, path).select("source_id").distinct().count() == 3 and store.metadata(spark, path).first()["present"]
    cli.main(["--config", config, "--store", path, "status"])
    cli.main(["--config", config, "--store", path, "sources"])
    cli.main(["--config", config, "--store", path, "search", "second", "--top-k", "2"])
    assert "guide" in capfd.readouterr().out
    g = graph.build_graph(store.load_chunks(spark, path))
    store.save_graph(g, path)
    assert store.load_graph(spark, path).edges.count() == g.edges.count()


def test_stream_merges_new_and_changed_files(spark, tmp_path):
    root, path, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    root.mkdir()
    (root / "a.md").write_text("# One\nx")
    (root / "skip.txt").write_text("no")
    follow(spark, str(root), "s", "markdown", path, check).awaitTermination()
    (root / "b.md").write_text("# Two\n# Three")
    follow(spark, str(root), "s", "markdown", path, check).awaitTermination()
    assert {(r["path"], r["title"]) for r in store.load_chunks(spark, path).collect()} == {("a.md", "One"), ("b.md", "Two"), ("b.md", "Three")}
    assert sorted(r["seq"] for r in store.load_chunks(spark, path).collect()) == [0, 1, 2]
    (root / "a.md").unlink()
    assert forget_missing(spark, str(root), "s", path) == 1 and {r["path"] for r in store.load_chunks(spark, path).collect()} == {"b.md"}
    (root / "b.md").unlink()
    assert forget_missing(spark, str(root), "s", path) == 2 and store.load_chunks(spark, path).count() == 0


def test_top_k_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, c, 0.5) for c in "dacb"], "query_id int, id string, score double")
    assert [r["id"] for r in lexical.top_k(rows, 3).orderBy("rank").collect()] == ["a", "b", "c"]
