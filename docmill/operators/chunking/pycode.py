"""Python modules, parsed with the standard library; the parser's output becomes rows, all else is expressions."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.schema import SYMBOL, as_chunks
from docmill.functions.text import chunk_id, stem_of
from docmill.plans.shared import written

_PARSED = "struct<doc:string,imports:array<string>,symbols:array<struct<name:string,kind:string,doc:string,signature:string,private:boolean,decorators:array<string>,return_type:string,parameters:array<struct<name:string,annotation:string,default:string,kind:string>>,bases:array<string>,is_async:boolean>>>"


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _parameters(a: ast.arguments) -> list[dict]:
    """Parameters in order; positional-only ones aren't listed."""
    late = [None] * (len(a.args) - len(a.defaults)) + list(a.defaults)[-len(a.args) or len(a.defaults) :]
    rows = [(x, d, "positional_or_keyword") for x, d in zip(a.args, late, strict=False)]
    rows += [(a.vararg, None, "var_positional")] if a.vararg else []
    rows += [(x, d, "keyword_only") for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    rows += [(a.kwarg, None, "var_keyword")] if a.kwarg else []
    return [{"name": x.arg, "annotation": _text(x.annotation), "default": _text(d), "kind": k} for x, d, k in rows]


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef, parameters: list[dict]) -> str:
    marks = {"var_positional": "*", "var_keyword": "**"}
    shown = [marks.get(p["kind"], "") + p["name"] + (f": {p['annotation']}" if p["annotation"] else "") + (f" = {p['default']}" if p["default"] else "") for p in parameters]
    kinds = [p["kind"] for p in parameters]
    if "keyword_only" in kinds and "var_positional" not in kinds:
        shown.insert(kinds.index("keyword_only"), "*")
    back = f" -> {_text(node.returns)}" if node.returns else ""
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({', '.join(shown)}){back}"


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str = "") -> dict:
    is_async = isinstance(node, ast.AsyncFunctionDef)
    parameters = _parameters(node.args)
    dunder = node.name.startswith("__") and node.name.endswith("__")
    return {
        "name": f"{owner}.{node.name}" if owner else node.name, "kind": ("async_" if is_async else "") + ("method" if owner else "function"), "doc": ast.get_docstring(node), "signature": _signature(node, parameters),
        "private": dunder or node.name.startswith("_") and not node.name.startswith("__"), "decorators": [_text(d) for d in node.decorator_list], "return_type": _text(node.returns), "parameters": parameters, "bases": [], "is_async": is_async,
    }


def _kept(s: dict, private: bool, dunder: bool) -> bool:
    """Private names and dunders go unless private ones are wanted; dunder functions then need dunder too, but for three."""
    if s["private"] and not private:
        return False
    special = s["name"].startswith("__") and s["name"].endswith("__")
    return not special or dunder or s["name"] in ("__init__", "__new__", "__call__")


def parse_module(text: str, private: bool = False, dunder: bool = False) -> dict | None:
    """Docstring, imports in walk order, and symbols: top-level classes, their methods, and functions. None: not Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [f"{node.module}.{a.name}" if node.module else a.name for a in node.names]
    symbols = []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, functions):
            symbols += [s for s in [_function(node)] if _kept(s, private, dunder)]
        elif isinstance(node, ast.ClassDef):
            bases = [_text(b) for b in node.bases]
            own = {"name": node.name, "kind": "class", "doc": ast.get_docstring(node), "signature": f"class {node.name}{f'({", ".join(bases)})' if bases else ''}:", "private": node.name.startswith("_") and not node.name.startswith("__"), "decorators": [_text(d) for d in node.decorator_list], "return_type": None, "parameters": [], "bases": bases, "is_async": False}
            if _kept(own, private, dunder):
                symbols += [own, *[m for m in (_function(n, node.name) for n in node.body if isinstance(n, functions)) if _kept(m, private, dunder)]]
    return {"doc": ast.get_docstring(tree), "imports": imports, "symbols": symbols}


# Marks of docstring styles.
NUMPY = r"(?m)^\s*(Parameters|Returns|Raises|Yields|Examples?|Attributes|Notes?|Warnings?)\s*\n\s*-+"
SPHINX = r"(?m)^\s*:(param|type|returns?|rtype|raises?|var|ivar|cvar):"


def docstring_style(doc: Column) -> Column:
    """numpy, sphinx or google by the marks of sections; google where there are none."""
    return F.when(doc.rlike(NUMPY), "numpy").when(doc.rlike(SPHINX), "sphinx").otherwise("google")


def _symbol(s: Column, *shown: str) -> Column:
    have = {"name": s["name"], "type": s["kind"], "signature": s["signature"], "has_docstring": F.coalesce(s["doc"], F.lit("")) != "", "return_type": s["return_type"], "parameters": s["parameters"], "bases": s["bases"], "is_async": s["is_async"]}
    kinds = {"has_docstring": "boolean", "parameters": "array<struct<name:string,annotation:string,default:string,kind:string>>", "bases": "array<string>", "is_async": "boolean"}
    return F.struct(*[(c if n in shown else F.lit(None).cast(kinds.get(n, "string"))).alias(n) for n, c in have.items()]).cast(SYMBOL)


def chunk_python(files: DataFrame, chunk_strategy: str = "symbol", include_private: bool = False, include_tests: bool = False, include_dunder: bool = False) -> DataFrame:
    """Chunks of modules: a chunk for each file, each symbol, or an overview with top-level symbols (``module``).

    Modules that don't parse give nothing, nor do test modules unless include_tests.
    """

    @F.pandas_udf(_PARSED)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [parse_module(t or "", include_private, include_dunder) or {"doc": None, "imports": None, "symbols": None} for t in texts]
            yield pd.DataFrame(rows, columns=["doc", "imports", "symbols"])

    name = F.element_at(F.split("path", "/"), -1)
    if not include_tests:
        files = files.where(~name.startswith("test_") & ~name.endswith("_test.py"))
    # Not deterministic for the optimizer, which else parses once more for the filter, and below a repartition.
    rows = files.withColumn("m", parsed.asNondeterministic()("content")).where("m.symbols is not null").withColumns({"doc": F.col("m.doc"), "imports": F.col("m.imports"), "symbols": F.col("m.symbols"), "stem": stem_of("path"), "file_modified": F.col("modified")}).drop("m")
    # Symbols and what is said of whole modules are read from the parsed modules apart; each module is parsed once.
    rows = rows if chunk_strategy == "file" else written(rows, "modules")
    rows = rows.withColumns({"language": F.lit("python"), "code_blocks": F.array(F.lit("python")), "chunk_class": F.lit("source"), "chunk_type": F.lit("source")})
    one_id = lambda part: chunk_id(F.col("source_id"), F.lit("python"), F.concat("path", part))
    first = F.trim(F.split_part(F.coalesce("doc", F.lit("")), F.lit("\n"), F.lit(1)))
    public = F.filter("symbols", lambda s: ~s["private"])
    whole = rows.withColumns({
        "id": one_id(F.lit("")), "title": F.when(first != "", F.concat("stem", F.lit(" - "), F.substring(first, 1, 60))).otherwise(F.col("stem")), "kind": F.lit("source"), "file_type": F.lit("module"),
        "exports": F.transform(public, lambda s: F.element_at(F.split(s["name"], r"\."), -1)), "symbols_extracted": F.transform("symbols", lambda s: _symbol(s, "name", "type", "signature", "has_docstring")),
    })
    if chunk_strategy == "file":
        return as_chunks(whole)
    module = chunk_strategy == "module"
    s = F.col("s")
    method = s["kind"].endswith("method")
    parts = rows.select("*", F.posexplode("symbols").alias("_at", "s")).withColumn("seq", F.col("_at") + 1).where(~method if module else F.lit(True))
    title = F.when(s["kind"] == "class", F.concat(F.lit("class "), s["name"])).when(method, F.concat(s["name"], F.lit("()"))).otherwise(F.concat(F.lit("def "), s["name"], F.lit("()")))
    has_doc = F.coalesce(s["doc"], F.lit("")) != ""
    parts = parts.withColumns({
        "id": one_id(F.concat(F.lit(":"), s["name"])), "anchor": F.replace(F.lower(s["name"]), F.lit("."), F.lit("-")), "title": title, "content": F.concat(s["signature"], F.when(has_doc, F.concat(F.lit("\n\n"), s["doc"])).otherwise("")),
        "kind": F.when(has_doc, "api").otherwise("source"), "depth": F.when(method | F.lit(module), 2).otherwise(1), "is_entrypoint": F.lit(False), "file_type": s["kind"], "decorators": s["decorators"], "imports": F.array().cast("array<string>"),
        "class_name": F.when(method, F.split_part(s["name"], F.lit("."), F.lit(1))),
        "symbols_extracted": F.array(_symbol(s, "name", "type", "signature", "bases") if module else _symbol(s, "name", "type", "signature", "return_type", "parameters", "bases", "is_async")),
    })
    if not module:
        about = rows.where(F.coalesce("doc", F.lit("")) != "").withColumns({"id": one_id(F.lit(":module")), "anchor": F.lit("module"), "title": F.concat("stem", F.lit(" (module)")), "content": F.col("doc"), "kind": F.lit("api"), "file_type": F.lit("module")})
        bare = whole.where((F.size("symbols") == 0) & (F.coalesce("doc", F.lit("")) == ""))
        return as_chunks(about).unionByName(as_chunks(parts)).unionByName(as_chunks(bare))
    top = lambda *kinds: F.filter("symbols", lambda x: x["kind"].isin(*kinds))
    bullet = lambda x, after: F.concat(F.lit("- `"), x["name"], F.lit(f"{after}`: "), F.when(F.coalesce(x["doc"], F.lit("")) != "", F.split_part(x["doc"], F.lit("\n"), F.lit(1))).otherwise("No description"))
    classes, functions = top("class"), top("function", "async_function")
    text = F.concat_ws(
        "\n", F.nullif("doc", F.lit("")), F.when(F.size(classes) > 0, F.concat(F.lit("\n## Classes\n\n"), F.array_join(F.transform(classes, lambda x: bullet(x, "")), "\n"))),
        F.when(F.size(functions) > 0, F.concat(F.lit("\n## Functions\n\n"), F.array_join(F.transform(functions, lambda x: bullet(x, "()")), "\n"))),
    )
    shown = top("class", "function", "async_function")
    about = rows.withColumns({
        "id": one_id(F.lit(":overview")), "anchor": F.lit("overview"), "title": F.concat("stem", F.lit(" (module overview)")), "content": F.when(text != "", text).otherwise(F.substring("content", 1, 2000)), "kind": F.lit("api"), "file_type": F.lit("module"),
        "exports": F.transform(F.filter(shown, lambda x: ~x["private"]), lambda x: x["name"]), "symbols_extracted": F.transform(shown, lambda x: _symbol(x, "name", "type")),
    })
    return as_chunks(about).unionByName(as_chunks(parts))
