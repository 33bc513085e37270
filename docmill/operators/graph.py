"""Component graph: nodes and edges as tables, built from chunks and queried by joins.

edges(src, dst, relation_type, weight, bidirectional, seq) keeps every relation in the order in which it was written.
``simple`` gives the view in which a later relation between two nodes replaces an earlier one.
Node ids are ``component:``, ``category:``, ``chunk:`` and ``source:`` + name. Adjacency queries take any number of names at
once and return one row for each answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.lexical import one_of
from docmill.plans.shared import few, local_table, sized, written

#: Relation types.
RELATIONS = "belongs_to has_variant extends uses related_to has_prop documents has_template has_stylesheet has_source imports references".split()
NODE_TYPES = "component category prop chunk source_file".split()


NODE_SCHEMA = "node_id string, node_type string, name string, category string, description string, chunk_id string, chunk_type string, parent_category string, language string, file_type string, seq long"
EDGE_SCHEMA = "src string, dst string, relation_type string, weight double, bidirectional boolean, seq long"
REACH_SCHEMA = f"node string, other string, {EDGE_SCHEMA}"


@dataclass
class Graph:
    nodes: DataFrame  # as NODE_SCHEMA
    edges: DataFrame  # as EDGE_SCHEMA
    reach: DataFrame | None = None  # as REACH_SCHEMA, of a stored graph: edges by either end, in ranges of nodes


def kept(graph: Graph) -> Graph:
    """The graph as tables in the shared folder, for plans that read it more than once."""
    return Graph(written(graph.nodes, "nodes"), written(graph.edges, "edges"))


def reach_of(edges: DataFrame) -> DataFrame:
    """Every edge under each of its ends, the other beside it."""
    rows = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *edges.columns)
    return rows.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *edges.columns))


def around(graph: Graph, asked: DataFrame) -> Graph:
    """What a stored graph has of the asked(asked) components and all that they touch, if that is little: read from their ranges and
    held in the plan. Else, and of other graphs, the graph itself."""
    ids = few(asked.select(component_id(F.col("asked")).alias("n")).distinct()) if graph.reach is not None else None
    if ids is None:
        return graph
    rows = few(graph.reach.where(one_of("node", sorted(r[0] for r in ids if r[0] is not None))))
    if rows is None:
        return graph
    spark, edges = graph.edges.sparkSession, {tuple(r)[2:] for r in rows}
    touched = sorted({n for r in rows for n in (r["node"], r["other"])} | {r[0] for r in ids if r[0] is not None})
    nodes = few(graph.nodes.where(one_of("node_id", touched)))
    return graph if nodes is None else Graph(local_table(spark, nodes, NODE_SCHEMA), local_table(spark, sorted(edges, key=str), EDGE_SCHEMA))


def _node(kind: str, prefix: str, name: Column, **more: Column) -> list[Column]:
    have = {"category": "string", "description": "string", "chunk_id": "string", "chunk_type": "string", "parent_category": "string", "language": "string", "file_type": "string"}
    return [F.concat(F.lit(f"{prefix}:"), name).alias("node_id"), F.lit(kind).alias("node_type"), name.alias("name"), *[more.get(c, F.lit(None)).cast(t).alias(c) for c, t in have.items()], F.col("seq")]


def _edge(src: Column, dst: Column, relation: Column | str, n: int, weight: float = 1.0, both: bool = False) -> list[Column]:
    """n: the place of this edge among those that one chunk writes."""
    relation = F.lit(relation) if isinstance(relation, str) else relation
    return [src.alias("src"), dst.alias("dst"), relation.alias("relation_type"), F.lit(weight).alias("weight"), F.lit(both).alias("bidirectional"), F.col("seq"), F.lit(n).alias("n"), F.coalesce(F.col("place"), F.lit(0)).alias("place")]


def with_nodes(graph: Graph, nodes: DataFrame) -> Graph:
    """The graph with nodes added or their blank attributes filled; nodes has node_type and name, the rest may be absent.

    A category that is new to the graph belongs to its parent category, which is added too.
    """
    prefix = F.when(F.col("node_type") == "source_file", "source").otherwise(F.col("node_type"))
    rows = nodes.withColumn("node_id", F.concat(prefix, F.lit(":"), "name"))
    parents = rows.where("node_type = 'category'").where(F.col("parent_category").isNotNull()) if "parent_category" in rows.columns else rows.limit(0).withColumn("parent_category", F.lit(""))
    parents = parents.select(F.lit("category").alias("node_type"), F.col("parent_category").alias("name"), F.concat(F.lit("category:"), "parent_category").alias("node_id"))
    last = graph.nodes.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
    known = merged_nodes(graph.nodes.unionByName(rows.unionByName(parents, allowMissingColumns=True).withColumn("seq", F.lit(last)), allowMissingColumns=True))
    if "parent_category" not in rows.columns:
        return Graph(known, graph.edges)
    new = rows.where("node_type = 'category' and parent_category is not null").join(graph.nodes.select("node_id"), "node_id", "left_anti")
    belongs = new.select(F.col("node_id").alias("src"), F.concat(F.lit("category:"), "parent_category").alias("dst"), F.lit("belongs_to").alias("relation_type")).distinct()
    return with_edges(Graph(known, graph.edges), belongs)


def with_edges(graph: Graph, edges: DataFrame, both_ways: bool = False) -> Graph:
    """The graph with edges(src, dst, relation_type) written after all others; ends that aren't known stay without attributes."""
    last = graph.edges.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
    rows = edges.select("src", "dst", "relation_type")
    rows = rows.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation_type")) if both_ways else rows
    rows = rows.select("*", F.lit(1.0).alias("weight"), F.lit(both_ways).alias("bidirectional"), F.lit(last).alias("seq"))
    return Graph(graph.nodes, graph.edges.unionByName(rows))


def size(graph: Graph) -> int:
    """The number of nodes."""
    return graph.nodes.count()


def contains(graph: Graph, node_ids: DataFrame) -> DataFrame:
    """node_ids(node_id) with whether the graph has each."""
    return node_ids.join(graph.nodes.select("node_id", F.lit(True).alias("present")), "node_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def component_id(name: Column) -> Column:
    return F.concat(F.lit("component:"), name)


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node: the first value of each attribute that isn't empty, in the order of writing."""
    first = [F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("seq", c)))[c].alias(c) for c in nodes.columns if c not in ("node_id", "node_type", "name", "seq")]
    return nodes.groupBy("node_id", "node_type", "name").agg(*first, F.min("seq").alias("seq"))


def simple(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair of nodes, the last written."""
    order = Window.partitionBy("src", "dst").orderBy(F.desc("seq"), F.desc("relation_type"))
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def build_graph(chunks: DataFrame, variants: bool = False, sources: bool = False, variant_extends: bool = True) -> Graph:
    """The graph of component chunks (as of as_chunks), and with ``sources`` of source chunks too.

    A component gets a node, an edge to its category, and one from each of its chunks. extends, uses and related_to give
    edges and nodes for what they name; variants only if asked for. With variant_extends a base also has its
    component as a variant.
    """
    comp = chunks.where("chunk_class = 'component' and coalesce(component_name, '') <> ''").withColumn("place", F.lit(0))
    name, category = F.col("component_name"), F.nullif(F.col("component_category"), F.lit(""))
    me = component_id(name)
    named = lambda c: comp.select("*", F.posexplode(c).alias("_p", "other")).where("coalesce(other, '') <> ''").withColumn("place", F.col("_p"))
    based = comp.withColumn("other", F.col("extends")).where("coalesce(other, '') <> ''")
    other = component_id(F.col("other"))
    nodes = comp.select(_node("component", "component", name, category=category, description=F.col("title") if variants else F.lit("")))
    nodes = nodes.union(comp.where(category.isNotNull()).select(_node("category", "category", category)))
    nodes = nodes.union(comp.select(_node("chunk", "chunk", F.col("id"), chunk_id=F.col("id"), chunk_type=F.col("chunk_type"))))
    edges = comp.where(category.isNotNull()).select(_edge(me, F.concat(F.lit("category:"), category), "belongs_to", 0))
    edges = edges.union(comp.select(_edge(F.concat(F.lit("chunk:"), F.col("id")), me, "documents", 1)))
    if variant_extends:
        edges = edges.union(based.select(_edge(other, me, "has_variant", 2)))
    edges = edges.union(based.select(_edge(me, other, "extends", 3)))
    for i, (column, relation) in enumerate((("uses", "uses"), *((("variants", "has_variant"),) if variants else ()), ("related_to", "related_to"))):
        rows = named(column)
        edges = edges.union(rows.select(_edge(me, other, relation, 4 + 2 * i, both=relation == "related_to")))
        if relation == "related_to":
            edges = edges.union(rows.select(_edge(other, me, relation, 5 + 2 * i, both=True)))
        if relation == "has_variant":
            edges = edges.union(rows.select(_edge(other, me, "extends", 5 + 2 * i)))
        nodes = nodes.union(rows.select(_node("component", "component", F.col("other"))))
    nodes = nodes.union(based.select(_node("component", "component", F.col("other"))))
    if sources:
        src = chunks.where("chunk_class = 'source' and coalesce(component_name, '') <> ''").withColumn("place", F.lit(0))
        file = F.concat(F.lit("source:"), F.col("path"))
        nodes = nodes.union(src.select(_node("component", "component", name))).union(src.select(_node("source_file", "source", F.col("path"), language=F.col("language"), file_type=F.col("file_type"))))
        relation = F.when(F.col("file_type") == "template", "has_template").when(F.col("file_type") == "stylesheet", "has_stylesheet").otherwise("has_source")
        edges = edges.union(src.select(_edge(me, file, relation, 20)))
        refs = src.select("*", F.posexplode("component_refs").alias("_p", "other")).withColumn("place", F.col("_p"))
        known = nodes.where("node_type = 'component'").select(F.col("name").alias("other")).distinct()
        edges = edges.union(refs.join(known, "other", "left_semi").select(_edge(file, other, "references", 21)))
    # Writing order: by chunk, then kind of edge, then place in the list, in one sortable number.
    edges = edges.withColumn("seq", F.col("seq") * 1_000_000 + F.col("n") * 10_000 + F.col("place")).drop("n", "place")
    return Graph(merged_nodes(nodes), edges)


def neighbours(graph: Graph, asked: DataFrame, relation: str, out: bool = True, node_type: str = "component") -> DataFrame:
    """(asked, name, seq): nodes of a type that an asked(asked) component has the relation to, or with out=False from, in writing order."""
    here, there = ("src", "dst") if out else ("dst", "src")
    rows = graph.edges.where(F.col("relation_type") == relation).join(sized(asked.select("asked", component_id(F.col("asked")).alias(here)).distinct()), here)
    names = graph.nodes.where(F.col("node_type") == node_type).select(F.col("node_id").alias(there), "name", "chunk_type")
    return rows.join(names, there).groupBy("asked", "name", "chunk_type").agg(F.min("seq").alias("seq"))


def variants_of(graph: Graph, asked: DataFrame) -> DataFrame:
    return neighbours(graph, asked, "has_variant")


def base_of(graph: Graph, asked: DataFrame) -> DataFrame:
    """The first base of each component."""
    return neighbours(graph, asked, "extends").withColumn("_n", F.row_number().over(Window.partitionBy("asked").orderBy("seq"))).where("_n = 1").drop("_n")


def uses_of(graph: Graph, asked: DataFrame) -> DataFrame:
    return neighbours(graph, asked, "uses")


def users_of(graph: Graph, asked: DataFrame) -> DataFrame:
    return neighbours(graph, asked, "uses", out=False)


def related_to(graph: Graph, asked: DataFrame) -> DataFrame:
    """Related components in either direction."""
    return neighbours(graph, asked, "related_to").union(neighbours(graph, asked, "related_to", out=False)).groupBy("asked", "name").agg(F.min("seq").alias("seq"))


def chunks_of(graph: Graph, asked: DataFrame, chunk_type: str | None = None) -> DataFrame:
    """(asked, chunk_id, chunk_type, seq) of the chunks that document a component."""
    rows = neighbours(graph, asked, "documents", out=False, node_type="chunk").withColumnRenamed("name", "chunk_id")
    return rows if chunk_type is None else rows.where(F.col("chunk_type") == chunk_type)


def members(graph: Graph, categories: DataFrame | None = None) -> DataFrame:
    """(category, name, seq): components of all categories, or of the asked(category) ones."""
    rows = graph.edges.where("relation_type = 'belongs_to'").withColumn("category", F.substring_index("dst", "category:", -1))
    if categories is not None:
        rows = rows.join(sized(categories.select("category").distinct()), "category")
    return rows.join(graph.nodes.select(F.col("node_id").alias("src"), "name"), "src").groupBy("category", "name").agg(F.min("seq").alias("seq"))


def find_nodes(graph: Graph, node_type: str, names: DataFrame | None = None) -> DataFrame:
    """Nodes of a type, all or those of asked(asked); seq is their writing order."""
    rows = graph.nodes.where(F.col("node_type") == node_type)
    return rows.join(sized(names.select(F.col("asked").alias("name")).distinct()), "name", "left_semi") if names is not None else rows


def walk(graph: Graph, asked: DataFrame, depth: int = 2, mode: str = "shortest") -> DataFrame:
    """(asked, name, distance): components within depth hops along edges of any kind in any direction, but the asked one.

    distance is the least number of hops. With mode ``walk`` it is the length of the longest walk of at most depth hops
    that ends there, which may pass a node more than once.
    """
    if graph.reach is None:
        every = written(reach_of(graph.edges).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "neighbours")
    else:
        every = graph.reach.select(F.col("node").alias("a"), F.col("other").alias("b"))
    known = graph.nodes.where("node_type = 'component'").select("node_id", "name")
    start = asked.select("asked", component_id(F.col("asked")).alias("node_id")).distinct().join(known.select("node_id"), "node_id", "left_semi")
    seen = written(start.withColumn("hops", F.lit(0)), "walk-0")
    front = seen
    for hop in range(1, depth + 1):
        ids = few(front.select("node_id").distinct()) if graph.reach is not None else None
        e = every if ids is None else every.where(one_of("a", sorted(r[0] for r in ids)))
        step = front.select("asked", F.col("node_id").alias("a")).join(e, "a").select("asked", F.col("b").alias("node_id")).distinct()
        if mode == "shortest":
            step = step.join(seen.select("asked", "node_id"), ["asked", "node_id"], "left_anti")
        front = written(step.withColumn("hops", F.lit(hop)), f"walk-{hop}")
        both = seen.unionByName(front)
        if mode != "shortest":
            both = both.groupBy("asked", "node_id").agg(F.max("hops").alias("hops"))
        seen = both
    out = seen.join(known, "node_id").where("name <> asked")
    return out.groupBy("asked", "name").agg((F.min if mode == "shortest" else F.max)("hops").alias("distance"))


def component_info(graph: Graph, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """One row for each known component: category, description, relations as sorted lists, and its chunks' titles by type."""
    graph = around(graph, asked)
    rows = find_nodes(graph, "component", asked).select(F.col("name").alias("asked"), "category", F.coalesce("description", F.lit("")).alias("description"))
    in_order = lambda df, to, what="name": df.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("seq", what))).alias("_l")).select("asked", F.transform("_l", lambda x: x[what]).alias(to))
    for to, found in (("variants", variants_of(graph, asked)), ("uses", uses_of(graph, asked)), ("used_by", users_of(graph, asked)), ("related_to", related_to(graph, asked))):
        rows = rows.join(in_order(found, to), "asked", "left")
    rows = rows.join(base_of(graph, asked).select("asked", F.col("name").alias("extends")), "asked", "left")
    docs = chunks_of(graph, asked).join(chunks.select(F.col("id").alias("chunk_id"), "title"), "chunk_id", "left")
    docs = docs.groupBy("asked", "chunk_type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("seq", "title"))).alias("t"))
    docs = docs.groupBy("asked").agg(F.sum("n").alias("chunk_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_type", F.transform("t", lambda x: x["title"]).alias("titles"))))).alias("by_type"))
    empty = F.array().cast("array<string>")
    rows = rows.join(docs, "asked", "left")
    return rows.select("asked", "category", "description", "extends", *[F.coalesce(c, empty).alias(c) for c in ("variants", "uses", "used_by", "related_to")], F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "by_type")


def list_categories(graph: Graph) -> DataFrame:
    """(name, description, component_count, components, seq) of every category; seq is the writing order."""
    rows = members(graph).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("component_count"), F.sort_array(F.collect_list(F.struct("seq", F.col("name")))).alias("_c"))
    known = graph.nodes.where("node_type = 'category'").select("name", F.coalesce("description", F.lit("")).alias("description"), "seq")
    out = known.join(rows.select("name", "component_count", F.transform("_c", lambda x: x["name"]).alias("components")), "name", "left")
    return out.select("name", "description", F.coalesce("component_count", F.lit(0)).alias("component_count"), F.coalesce("components", F.array().cast("array<string>")).alias("components"), "seq")


def explore_category(graph: Graph, chunks: DataFrame, category: str, include_chunks: bool = False) -> DataFrame:
    """(category, name, description[, chunks], seq) of a category's components; seq is the writing order."""
    spark = graph.nodes.sparkSession
    rows = members(graph, spark.createDataFrame([(category,)], "category string")).join(graph.nodes.where("node_type = 'component'").select("name", F.coalesce("description", F.lit("")).alias("description")), "name")
    if include_chunks:
        docs = chunks_of(graph, rows.select(F.col("name").alias("asked"))).join(chunks.select(F.col("id").alias("chunk_id"), "title"), "chunk_id")
        docs = docs.groupBy(F.col("asked").alias("name")).agg(F.sort_array(F.collect_list(F.struct("seq", "title"))).alias("_t")).select("name", F.transform("_t", lambda x: x["title"]).alias("chunks"))
        rows = rows.join(docs, "name", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))
    return rows


def filtered_search(scores: DataFrame, chunks: DataFrame, graph: Graph, k: int, component: str | None = None, category: str | None = None, chunk_type: str | None = None, include_related: bool = False, depth: int = 1) -> DataFrame:
    """The first k of ranked scores(query_id, id, score, rank) that are chunks of wanted components and type.

    A component goes before a category; with include_related, components within depth of a wanted one are wanted too.
    Nothing beyond the given scores is looked for, and an unknown chunk type asks for nothing.
    """
    from docmill.functions.vocabulary import CHUNK_TYPES

    spark = chunks.sparkSession
    comp = chunks.select("id", "title", "path", "chunk_class", "component_name", "component_category", "chunk_type")
    rows = scores.join(comp, "id")
    if component or category:
        wanted = spark.createDataFrame([(component,)], "asked string") if component else members(graph, spark.createDataFrame([(category,)], "category string")).select(F.col("name").alias("asked"))
        if include_related:
            wanted = wanted.union(walk(graph, wanted, depth).select("name")).distinct()
        rows = rows.where("chunk_class = 'component'").join(sized(wanted.select(F.col("asked").alias("component_name")).distinct()), "component_name", "left_semi")
    if chunk_type in CHUNK_TYPES:
        rows = rows.where((F.col("chunk_class") == "component") & (F.col("chunk_type") == chunk_type))
    order = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def graph_json(graph: Graph) -> DataFrame:
    """(kind, json): nodes and edges as JSON rows."""
    return graph.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*graph.nodes.columns)).alias("json")).union(graph.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*graph.edges.columns)).alias("json")))


def graph_from_json(rows: DataFrame) -> Graph:
    part = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("r")).select("r.*")
    return Graph(part("node", NODE_SCHEMA), part("edge", EDGE_SCHEMA))

