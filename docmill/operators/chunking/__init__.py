"""Chunkers: files (source_id, path, content, modified, is_entrypoint) to chunks, whose seq is their place in the file. One scan, no shuffle, each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docmill.operators.chunking.apidoc import chunk_apidoc
from docmill.operators.chunking.pycode import chunk_python
from docmill.operators.chunking.sections import chunk_component, chunk_markdown
from docmill.operators.chunking.webcode import chunk_source

#: By the adapter's name in source configurations: (extensions, chunker). API docs come by file name instead.
CHUNKERS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "markdown": (("md", "mdx"), chunk_markdown),
    "component": (("md", "mdx"), chunk_component),
    "compodoc": ((), chunk_apidoc),
    "source": (("ts", "tsx", "js", "jsx", "html", "htm", "scss", "sass", "css", "py"), chunk_source),
    "python": (("py", "pyw"), chunk_python),
}
#: Adapters whose chunkers give the chunks of files as the files come, each file's in order. Those of others are sorted.
IN_ORDER = {"markdown", "component"}
