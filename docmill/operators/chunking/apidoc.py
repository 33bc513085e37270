"""API documentation in JSON: overview, inputs, outputs and methods of components, directives and services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.schema import as_chunks
from docmill.functions.text import chunk_id, strip_html, without_suffix
from docmill.functions.vocabulary import CATEGORY_FOLDERS, PLAIN_FOLDERS

_FIELD = "name:string,type:string,defaultValue:string,description:string,rawdescription:string,deprecated:boolean"
_ENTRY = (
    "array<struct<name:string,file:string,selector:string,description:string,rawdescription:string,extends:string,imports:array<string>,standalone:boolean,"
    f"inputsClass:array<struct<{_FIELD}>>,outputsClass:array<struct<{_FIELD}>>,"
    "methodsClass:array<struct<name:string,args:array<struct<name:string,type:string>>,returnType:string,description:string,rawdescription:string>>>>"
)
API_SCHEMA = f"struct<components:{_ENTRY},directives:{_ENTRY},injectables:{_ENTRY}>"


def _or(c: Column, other: str) -> Column:
    """c, or other where it is null or empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(other)).otherwise(c)


def _described(e: Column) -> Column:
    return strip_html(F.coalesce(F.nullif(e["description"], F.lit("")), e["rawdescription"], F.lit("")))


def category_of(path: Column, default: Column) -> Column:
    """A known folder's name in the path; else the folder above the file of a component or directive; else default."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    known = F.get(F.filter(parts, lambda p: p.isin(CATEGORY_FOLDERS)), F.lit(0))
    above = F.zip_with(parts, F.slice(parts, 2, F.size(parts)), lambda a, b: F.when((b.endswith(".component.ts") | b.endswith(".directive.ts")) & ~a.isin(PLAIN_FOLDERS), a))
    above = F.get(F.filter(above, lambda a: a.isNotNull()), F.lit(0))
    return F.when(F.coalesce(path, F.lit("")) == "", default).otherwise(F.coalesce(F.initcap(F.replace(F.coalesce(known, above), F.lit("-"), F.lit(" "))), default))


def _table(e: Column, label: str, fields: str, kind: str, with_default: bool) -> Column:
    head = [f"| {label} | Type | Default | Description |", "|-------|------|---------|-------------|"] if with_default else [f"| {label} | Type | Description |", "|--------|------|-------------|"]

    def row(f: Column) -> Column:
        said = F.concat(F.when(f["deprecated"], "**DEPRECATED** ").otherwise(""), _or(_described(f), "-"))
        cells = [F.lit("| `"), F.coalesce(f["name"], F.lit("")), F.lit("` | `"), F.coalesce(f["type"], F.lit(kind)), F.lit("` | ")]
        if with_default:
            cells += [F.lit("`"), _or(f["defaultValue"], "-"), F.lit("` | ")]
        return F.concat(*cells, said, F.lit(" |"))

    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), e["name"], F.lit(f" {label}s")), *[F.lit(x) for x in ("", *head)]), F.transform(e[fields], row)), "\n")


def _methods(e: Column) -> Column:
    def lines(m: Column) -> Column:
        args = F.array_join(F.transform(F.coalesce(m["args"], F.array().cast("array<struct<name:string,type:string>>")), lambda a: F.concat(F.coalesce(a["name"], F.lit("arg")), F.lit(": "), F.coalesce(a["type"], F.lit("any")))), ", ")
        head = F.concat(F.lit("## `"), F.coalesce(m["name"], F.lit("")), F.lit("("), args, F.lit("): "), F.coalesce(m["returnType"], F.lit("void")), F.lit("`"))
        return F.filter(F.array(head, F.when(_described(m) != "", F.concat(F.lit("\n"), _described(m))), F.lit("")), lambda x: x.isNotNull())

    shown = F.filter(e["methodsClass"], lambda m: ~F.coalesce(m["name"], F.lit("")).startswith("ng"))
    return F.when(F.size(shown) > 0, F.array_join(F.concat(F.array(F.concat(F.lit("# "), e["name"], F.lit(" Methods")), F.lit("")), F.flatten(F.transform(shown, lines))), "\n"))


def _overview(e: Column, category: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"\n**{name}:** "), value)
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), e["name"]), F.when(_described(e) != "", F.concat(F.lit("\n"), _described(e))), F.when(F.coalesce(e["selector"], F.lit("")) != "", line("Selector", F.concat(F.lit("`"), e["selector"], F.lit("`")))),
        line("Category", category), F.when(e["standalone"], line("Standalone", F.lit("Yes"))), F.when(F.coalesce(e["extends"], F.lit("")) != "", line("Extends", e["extends"])),
    )


def _chunk(tag: str, anchor: str | None, title: Column, content: Column, chunk_type: str, category: Column, e: Column, entry: bool = False, uses: Column | None = None, props: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.when(content.isNotNull(), F.struct(
        F.lit(tag).alias("tag"), F.lit(anchor).cast("string").alias("anchor"), title.alias("title"), content.alias("content"), F.lit(chunk_type).alias("chunk_type"), category.alias("component_category"), e["name"].alias("component_name"),
        F.coalesce(e["file"], F.lit("")).alias("path"), F.lit(1 if anchor is None else 2).alias("depth"), F.lit(entry).alias("is_entrypoint"), F.lit(anchor in ("inputs", "outputs")).alias("has_table"),
        (e["extends"] if entry else F.lit(None).cast("string")).alias("extends"), F.coalesce(uses if uses is not None else none, none).alias("uses"), F.coalesce(props if props is not None else none, none).alias("props_mentioned"),
    ))


def chunk_apidoc(files: DataFrame, default_category: str = "Components", category_from_path: bool = True, include_directives: bool = True, include_services: bool = True, json_path: str = "documentation.json") -> DataFrame:
    """Chunks of the files named like json_path. Lifecycle methods (ng...) are left out; unreadable JSON gives nothing."""
    name = json_path.rsplit("/", 1)[-1]
    docs = files.where(F.element_at(F.split("path", "/"), -1) == name).select("source_id", "modified", F.from_json("content", API_SCHEMA).alias("api"))
    named = lambda part: F.transform(F.coalesce(F.col(f"api.{part}"), F.array().cast(_ENTRY)), lambda e: e.withField("name", F.coalesce(e["name"], F.lit("Unknown"))))

    def category(e: Column, default: str) -> Column:
        default_ = F.lit(default_category or default)
        return category_of(e["file"], default_) if category_from_path else default_

    def inputs(e: Column, default: str) -> Column:
        return _chunk("inputs", "inputs", F.concat(e["name"], F.lit(" Inputs")), F.when(F.size(e["inputsClass"]) > 0, _table(e, "Input", "inputsClass", "any", True)), "inputs", category(e, default), e, props=F.transform(e["inputsClass"], lambda f: F.coalesce(f["name"], F.lit(""))))

    def component(e: Column) -> Column:
        c = category(e, "")
        uses = F.transform(F.filter(e["imports"], lambda i: F.coalesce(i, F.lit("")) != ""), lambda i: without_suffix(i, ["Module", "Component"]))
        return F.array(
            _chunk("overview", None, e["name"], _overview(e, c), "overview", c, e, entry=True, uses=uses), inputs(e, ""),
            _chunk("outputs", "outputs", F.concat(e["name"], F.lit(" Outputs")), F.when(F.size(e["outputsClass"]) > 0, _table(e, "Output", "outputsClass", "EventEmitter", False)), "outputs", c, e),
            _chunk("methods", "methods", F.concat(e["name"], F.lit(" Methods")), _methods(e), "methods", c, e),
        )

    def directive(e: Column) -> Column:
        title = F.concat(e["name"], F.lit(" (Directive)"))
        said = F.when(_described(e) != "", F.concat(_described(e), F.lit("\n\n"))).otherwise("")
        shown = F.when(F.coalesce(e["selector"], F.lit("")) != "", F.concat(F.lit("**Selector:** `"), e["selector"], F.lit("`\n"))).otherwise("")
        return F.array(_chunk("directive-overview", None, title, F.concat(F.lit("# "), title, F.lit("\n\n"), said, shown), "overview", category(e, "Directives"), e), inputs(e, "Directives"))

    def service(e: Column) -> Column:
        title = F.concat(e["name"], F.lit(" (Service)"))
        said = F.when(_described(e) != "", F.concat(_described(e), F.lit("\n\n"))).otherwise("")
        bullets = F.array_join(F.transform(e["methodsClass"], lambda m: F.concat(F.lit("- `"), F.coalesce(m["name"], F.lit("")), F.lit("(): "), F.coalesce(m["returnType"], F.lit("void")), F.lit("`\n"))), "")
        methods = F.when(F.size(e["methodsClass"]) > 0, F.concat(F.lit("## Methods\n\n"), bullets)).otherwise("")
        return F.array(_chunk("service-overview", None, title, F.concat(F.lit("# "), title, F.lit("\n\n"), said, methods), "overview", category(e, "Services"), e))

    parts = [F.flatten(F.transform(named("components"), component))]
    if include_directives:
        parts.append(F.flatten(F.transform(named("directives"), directive)))
    if include_services:
        parts.append(F.flatten(F.transform(named("injectables"), service)))
    rows = docs.select("source_id", F.col("modified").alias("file_modified"), F.posexplode(F.filter(F.concat(*parts), lambda c: c.isNotNull())).alias("seq", "c")).select("source_id", "file_modified", "seq", "c.*")
    rows = rows.withColumns({"id": chunk_id(F.col("source_id"), F.lit("compodoc"), F.col("component_name"), F.col("tag")), "kind": F.lit("api_doc"), "chunk_class": F.lit("component")})
    return as_chunks(rows.drop("tag"))
