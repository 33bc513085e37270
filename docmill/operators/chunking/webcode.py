"""Source files of web applications: language, file type, symbols and related files by pattern."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.schema import SYMBOL, as_chunks
from docmill.functions.text import all_matches, chunk_id, first_match, kebab_to_pascal, stem_of, without_suffix
from docmill.functions.vocabulary import FILE_TYPES, LANGUAGES, NAME_SUFFIXES

# What counts as a symbol.
CLASS = r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"
FUNCTION = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"
INTERFACE = r"(?:export\s+)?interface\s+(\w+)"
DECORATOR = r"@(\w+)\s*\("
IMPORT = r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]"
COMPONENT = r"(?s)@Component\s*\(\s*\{([^}]+)\}\s*\)"
SELECTOR = r"selector\s*:\s*['\"]([^'\"]+)['\"]"
TEMPLATE_URL = r"templateUrl\s*:\s*['\"]([^'\"]+)['\"]"
STYLE_URLS = r"(?s)styleUrls\s*:\s*\[(.*?)\]"
COMPONENT_TAG = r"(?i)<(app-[a-z][a-z0-9-]*|tds-[a-z][a-z0-9-]*)"
RELATED = [".ts", ".html", ".scss", ".css", ".spec.ts"]


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(F.lit(False), "")
    for language, extensions in LANGUAGES.items():
        out = out.when(extension.isin(extensions), language)
    return out


def file_type_of(path: Column) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, kind in FILE_TYPES:
        out = out.when(path.rlike(pattern), kind)
    return out.otherwise("source")


def component_refs(content: Column) -> Column:
    """Components whose tags are in a template."""
    return F.transform(all_matches(content, COMPONENT_TAG, 1), lambda t: kebab_to_pascal(t))


def symbols(content: Column, language: Column) -> dict[str, Column]:
    """Columns of what patterns find; TypeScript and HTML have patterns, other languages give nothing."""
    ts, none = language == "typescript", F.array().cast("array<string>")
    found = lambda pattern: F.when(ts, all_matches(content, pattern, 1)).otherwise(none)
    block = F.when(ts, first_match(content, COMPONENT))
    urls = all_matches(first_match(block, STYLE_URLS), r"['\"]([^'\"]+)['\"]", 1)
    return {
        "classes": found(CLASS), "functions": found(FUNCTION), "interfaces": found(INTERFACE), "decorators": F.array_sort(F.array_distinct(found(DECORATOR))), "imports": found(IMPORT),
        "selector": first_match(block, SELECTOR), "template_url": first_match(block, TEMPLATE_URL), "style_urls": F.coalesce(urls, none),
        "component_refs": F.when(language == "html", component_refs(content)).otherwise(none),
    }


def component_name(path: Column, classes: Column) -> Column:
    return F.coalesce(without_suffix(F.get(classes, F.lit(0))), kebab_to_pascal(without_suffix(stem_of(path), [f".{s.lower()}" for s in NAME_SUFFIXES])))


def related_files(files: DataFrame) -> DataFrame:
    """(source_id, path, related_files): the other files of a component's or directive's folder with its stem."""
    stem = stem_of("path")
    own = files.where(stem.endswith(".component") | stem.endswith(".directive")).select("source_id", "path", F.regexp_replace("path", r"\.[^./]*$", "").alias("base"))
    ends = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(e).alias("e")) for i, e in enumerate(RELATED)])
    wanted = own.withColumn("end", F.explode(ends)).select("source_id", "path", F.col("end.n").alias("n"), F.concat("base", "end.e").alias("other")).where("path <> other")
    there = files.select("source_id", F.col("path").alias("other")).distinct()
    rows = wanted.join(there, ["source_id", "other"]).groupBy("source_id", "path").agg(F.sort_array(F.collect_list(F.struct("n", "other"))).alias("r"))
    return rows.select("source_id", "path", F.transform("r", lambda x: x["other"]).alias("related_files"))


def _class_start(content: Column, name: Column) -> Column:
    """Where the class opens, with an export before it, from 1; 0 if it doesn't."""
    pattern = F.concat(F.lit(r"(?s)(export\s+)?class\s+"), name, F.lit(r"\s*.*?\{"))
    return F.regexp_instr(content, pattern)


def chunk_source(files: DataFrame, chunk_strategy: str = "file", languages: Iterable[str] | None = None) -> DataFrame:
    """One chunk for each file; with the strategy ``symbol`` one for each class, of 2000 characters, where there are any."""
    rows = files.withColumns({"language": language_of(F.col("path")), "file_type": file_type_of(F.col("path"))}).where("language is not null")
    if languages is not None:
        rows = rows.where(F.col("language").isin(list(languages)))
    rows = rows.join(related_files(files), ["source_id", "path"], "left").withColumns(symbols(F.col("content"), F.col("language")))
    kind = F.when(F.col("file_type").isin("template", "stylesheet"), F.col("file_type")).otherwise("source")
    rows = rows.withColumns({"component_name": component_name(F.col("path"), F.col("classes")), "file_modified": F.col("modified"), "chunk_class": F.lit("source"), "code_blocks": F.array("language"), "kind": kind})
    symbol = lambda s, t: F.struct(s.alias("name"), F.lit(t).alias("type"), *[F.lit(None).cast(k).alias(n) for n, k in (("signature", "string"), ("has_docstring", "boolean"), ("return_type", "string"), ("parameters", "array<struct<name:string,annotation:string,default:string,kind:string>>"), ("bases", "array<string>"), ("is_async", "boolean"))]).cast(SYMBOL)
    found = F.concat(F.transform("classes", lambda s: symbol(s, "class")), F.transform("functions", lambda s: symbol(s, "function")), F.transform("component_refs", lambda s: symbol(s, "component_ref")))
    whole = rows.withColumns({
        "id": chunk_id(F.col("source_id"), F.lit("source"), F.col("path")), "title": F.when(F.col("component_name") != "", F.concat("component_name", F.lit(" ("), "file_type", F.lit(")"))).otherwise(F.element_at(F.split("path", "/"), -1)),
        "chunk_type": F.col("kind"), "class_name": F.get("classes", F.lit(0)), "exports": F.concat("classes", "functions"), "symbols_extracted": found,
    })
    if chunk_strategy != "symbol":
        return as_chunks(whole)
    at = F.filter(F.transform(F.array_distinct("classes"), lambda c: F.struct(c.alias("name"), _class_start(F.col("content"), c).alias("at"))), lambda x: x["at"] > 0)
    placed = whole.withColumn("placed", at)
    parts = placed.select("*", F.posexplode("placed").alias("seq", "p"))
    name = F.col("p.name")
    parts = parts.withColumns({
        "id": chunk_id(F.col("source_id"), F.lit("source"), F.col("path"), name), "anchor": F.lower(name), "title": name, "content": F.substr("content", F.col("p.at"), F.lit(2000)), "kind": F.lit("source"), "depth": F.lit(2),
        "class_name": name, "is_entrypoint": F.lit(False), "chunk_type": F.lit("source"),
    }).drop("p", "placed", "exports", "imports", "selector", "template_url", "style_urls", "related_files", "symbols_extracted", "component_refs")
    return as_chunks(parts).unionByName(as_chunks(placed.where(F.size("placed") == 0).drop("related_files")))
