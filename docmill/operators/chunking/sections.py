"""Markdown and component documents, one chunk for each section."""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.schema import as_chunks
from docmill.functions.text import all_matches, chunk_id, kebab_to_pascal, let, slug, stem_of
from docmill.functions.vocabulary import PLAIN_TAGS, SECTION_KEYWORDS

_BEFORE_HEADING = r"(?md)^(?=#{1,6}[^\S\n][^\n])"
_FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n"


def sections(content: Column, opening: str) -> Column:
    """array of (title, anchor, depth, content, code_blocks, has_table), in order; they join by line ends to content.

    A line of one to six # and text opens a section, also inside code. What stands before the first is titled
    ``opening``, without an anchor; so is an empty document.
    """

    def section(piece: Column, i: Column, n: Column) -> Column:
        text = F.when(i < n - 1, F.regexp_replace(piece, r"\n\z", "")).otherwise(piece)
        line = F.split_part(text, F.lit("\n"), F.lit(1))
        heading = line.rlike(r"^#{1,6}\s.")
        title = F.when(heading, F.regexp_replace(F.regexp_replace(line, r"^#{1,6}\s+", ""), r"(?U)^\s+|\s+$", "")).otherwise(opening)
        fences = F.array_sort(F.array_distinct(all_matches(text, r"(?mdU)^```(\w+)", 1)))
        return F.struct(
            title.alias("title"), F.when(heading, slug(title)).alias("anchor"), F.when(heading, F.length(F.regexp_extract(line, r"^#+", 0))).otherwise(1).alias("depth"),
            text.alias("content"), fences.alias("code_blocks"), text.rlike(r"(?md)^\|.+\|$").alias("has_table"),
        )

    # The pieces are cut once; inside the transformation their expression would be worked out for each of them.
    return let(F.split(content, _BEFORE_HEADING), lambda pieces: let(F.size(pieces), lambda n: F.transform(pieces, lambda piece, i: section(piece, i, n))))


def kind_of_path(path: Column, component: bool = False) -> Column:
    low = F.lower(path)
    kind = F.when(low.contains("agents.md"), "module") if not component else F.when(F.lit(False), "")
    kind = kind.when(low.contains("readme.md"), "readme").when(low.contains("api") | low.contains("reference"), "api").when(low.contains("example"), "example")
    if not component:
        kind = kind.when(low.contains("getting_started") | low.contains("quickstart"), "guide")
    return kind.otherwise("reference")


def section_type(title: Column, content: Column) -> Column:
    """The first type of which a keyword is in the title or in the content's first 500 characters; else overview."""
    t, head = F.lower(title), F.lower(F.substring(content, 1, 500))
    out = F.when(F.lit(False), "")
    for kind, keywords in SECTION_KEYWORDS:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | t.contains(k) | head.contains(k)
        out = out.when(hit, kind)
    return out.otherwise("overview")


def jsx_components(content: Column) -> Column:
    return F.array_except(F.array_distinct(all_matches(content, r"<([A-Z][a-zA-Z0-9]*)", 1)), F.array(*[F.lit(t) for t in PLAIN_TAGS]))


def imported_components(content: Column) -> Column:
    """Capitalised names of named and default imports, without aliases, in order."""
    both = all_matches(content, r"import\s+(\{[^}]+\}|\w+)\s+from\s+['\"][^'\"]+['\"]", 1)
    names = F.flatten(F.transform(both, lambda s: F.split(F.regexp_replace(s, r"^\{|\}$", ""), ",")))
    names = F.transform(names, lambda s: F.split_part(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), F.lit(" as "), F.lit(1)))
    return F.filter(names, lambda s: s.rlike(r"^\p{Lu}"))


def front_matter(content: Column | str) -> Column:
    """The YAML at the head of a document as a struct; nulls and empty lists where there is none or it can't be read."""
    return F.pandas_udf(_front_rows, "struct<component:string,category:string,extends:string,uses:array<string>,variants:array<string>,related:array<string>>")(content)


def _front_rows(content: pd.Series) -> pd.DataFrame:
    out = []
    for text in content:
        m = re.match(_FRONT, text or "")
        try:
            found = yaml.safe_load(m[1]) if m else {}
        except yaml.YAMLError:
            found = {}
        found = found if isinstance(found, dict) else {}
        row = {k: None if found.get(k) is None else str(found[k]) for k in ("component", "category", "extends")}
        for k in ("uses", "variants", "related"):
            v = found.get(k) or []
            row[k] = [str(x) for x in (v if isinstance(v, list) else [v])]
        out.append(row)
    return pd.DataFrame(out, columns=["component", "category", "extends", "uses", "variants", "related"])


def _split(files: DataFrame, content: Column, opening: str) -> DataFrame:
    rows = files.select("*", F.posexplode(sections(content, opening)).alias("seq", "s")).drop("content")
    return rows.select(*[c for c in rows.columns if c != "s"], "s.*").withColumn("id", chunk_id(F.col("source_id"), F.col("path"), F.coalesce(F.nullif("anchor", F.lit("")), F.lit("root"))))


def chunk_markdown(files: DataFrame) -> DataFrame:
    rows = _split(files, F.col("content"), "Introduction")
    return as_chunks(rows.withColumns({"kind": kind_of_path(F.col("path")), "file_modified": F.col("modified")}))


def chunk_component(files: DataFrame, default_category: str = "") -> DataFrame:
    """Sections with what the front matter, tags and imports say of the component; uses can name the component itself."""
    body = F.regexp_replace("content", _FRONT, "")
    stem = stem_of("path")
    rows = files.withColumn("front", front_matter("content"))
    rows = rows.withColumns({
        "component_name": F.coalesce(F.nullif("front.component", F.lit("")), F.when(stem.contains("-"), kebab_to_pascal(stem)).otherwise(stem)),
        "component_category": F.coalesce(F.nullif("front.category", F.lit("")), F.lit(default_category)), "extends": F.col("front.extends"),
        "uses": F.array_sort(F.array_union(F.array_union("front.uses", jsx_components(body)), imported_components(body))), "variants": F.col("front.variants"), "related_to": F.col("front.related"),
    })
    rows = _split(rows.drop("front"), body, "Overview").withColumns({"kind": kind_of_path(F.col("path"), component=True), "chunk_type": section_type(F.col("title"), F.col("content")), "file_modified": F.col("modified"), "chunk_class": F.lit("component")})
    props = F.filter(all_matches("content", r"(?mdU)^\s*(\w+)\s*[?:]", 1), lambda p: ~p.startswith("_"))
    variant = F.trim(F.replace(F.lower("title"), F.lit("example"), F.lit("")))
    named = (F.col("chunk_type") == "example") & F.lower("title").contains("example") & (F.length(variant) > 2)
    return as_chunks(rows.withColumns({"props_mentioned": F.when(F.col("chunk_type") == "props", props), "example_variant": F.when(named, F.initcap(variant))}))


def promoted(chunks: DataFrame, component_name: str, component_category: str = "", chunk_type: str = "overview") -> DataFrame:
    """Plain chunks as chunks of a component."""
    return as_chunks(chunks.withColumns({"component_name": F.lit(component_name), "component_category": F.lit(component_category), "chunk_type": F.lit(chunk_type), "chunk_class": F.lit("component")}))


def is_component_chunk(chunk_class: Column) -> Column:
    return chunk_class == "component"


def is_source_chunk(chunk_class: Column) -> Column:
    return chunk_class == "source"
