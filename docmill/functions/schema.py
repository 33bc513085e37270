"""Columns of the chunk table and what they are where a chunker doesn't set them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL = (
    "struct<name:string,type:string,signature:string,has_docstring:boolean,return_type:string,"
    "parameters:array<struct<name:string,annotation:string,default:string,kind:string>>,bases:array<string>,is_async:boolean>"
)
#: Name, type and default of every column, in order.
CHUNK = [
    ("id", "string", None), ("source_id", "string", None), ("path", "string", None), ("anchor", "string", None), ("title", "string", None), ("content", "string", None),
    ("kind", "string", "reference"), ("depth", "int", 1), ("is_entrypoint", "boolean", False), ("headings", "array<string>", []), ("code_blocks", "array<string>", []),
    ("has_table", "boolean", False), ("indexed_at", "timestamp_ntz", None), ("file_modified", "timestamp_ntz", None), ("chunk_class", "string", "normalized"),
    ("component_name", "string", None), ("component_category", "string", None), ("chunk_type", "string", None), ("extends", "string", None), ("uses", "array<string>", []),
    ("variants", "array<string>", []), ("related_to", "array<string>", []), ("props_mentioned", "array<string>", []), ("api_signatures", "array<string>", []),
    ("example_variant", "string", None), ("language", "string", None), ("file_type", "string", None), ("class_name", "string", None), ("decorators", "array<string>", []),
    ("exports", "array<string>", []), ("imports", "array<string>", []), ("selector", "string", None), ("template_url", "string", None), ("style_urls", "array<string>", []),
    ("related_files", "array<string>", []), ("symbols_extracted", f"array<{SYMBOL}>", []), ("component_refs", "array<string>", []), ("seq", "long", 0),
]
CHUNK_SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in CHUNK)
CHUNK_COLUMNS = [n for n, _, _ in CHUNK]


def default(name: str) -> Column:
    kind, value = next((t, v) for n, t, v in CHUNK if n == name)
    if value == []:
        return F.array().cast(kind)
    return F.lit(value).cast(kind)


def as_chunks(df: DataFrame) -> DataFrame:
    """df with all chunk columns and no others; absent columns and absent lists get their defaults."""
    out = []
    for name, kind, value in CHUNK:
        c = F.col(name).cast(kind) if name in df.columns else default(name)
        out.append((F.coalesce(c, default(name)) if name in df.columns and value is not None else c).alias(name))
    return df.select(out)
