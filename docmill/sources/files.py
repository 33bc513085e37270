"""File scans: folders are listed and files read by tasks, globs are regular expressions over the listing."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.plans.shared import BATCH_BYTES, BATCH_ROWS, few, local_table, written

#: Entries of folders after which a task leaves the folders below them to others.
ENTRIES = 10_000
#: Files and bytes that one task reads, about.
TASK_FILES, TASK_BYTES = 5_000, 64 << 20


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _path(spark, path)
    return bool(path) and store.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's file sources name it."""
    p, store = _path(spark, path)
    return store.makeQualified(p).toString().rstrip("/")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, on the driver, from any store that Spark reads."""
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written from the driver to any store that Spark writes."""
    p, store = _path(spark, path)
    out = store.create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder."""
    p, store = _path(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(p)) if store.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, store = _path(spark, path)
    store.delete(p, True)


def glob_regex(glob: str) -> str:
    """A path pattern where ** crosses folders, none too, and * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c, i = glob[i], i + 1
            end = glob.find("]", i + 1) if c == "[" else -1
            if end > 0:
                inner = glob[i:end].replace("\\", "\\\\")
                out, i = out + f"[{'^' + inner[1:] if inner[0] == '!' else inner}]", end + 1
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
    return f"(?s)^{out}$"


def fnmatch_regex(pattern: str) -> str:
    """A pattern where * and ? match any characters, / too."""
    return "(?s)^" + re.sub(r"\\\*|\\\?", lambda m: ".*" if m[0] == r"\*" else ".", re.escape(pattern)) + "$"


def decoded(content: Column, latin: bool) -> Column:
    """Bytes as text: UTF-8, and if that fails Latin-1 if ``latin``, else null."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.coalesce(text, F.decode(content, "ISO-8859-1")) if latin else text


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*"

def opened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, modificationTime, length, content) of the files at these paths, or below them if they are folders."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    paths = [re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths]  # a path, not a pattern
    return spark.read.format("binaryFile").schema(kind).option("recursiveFileLookup", True).load(paths) if paths else spark.createDataFrame([], kind)


def system_of(base: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a qualified path, and the path there."""
    return (fs.LocalFileSystem(), "/" + base[5:].lstrip("/")) if base.startswith("file:") else fs.FileSystem.from_uri(base.replace("s3a://", "s3://", 1))


def _by_tasks(base: str) -> bool:
    """Is it a folder that tasks can list by themselves? What only Spark reaches is listed by Spark's driver."""
    try:
        system, at = system_of(base)
        return system.get_file_info(at).type == fs.FileType.Directory
    except Exception:  # noqa: BLE001  pyarrow doesn't know the store, or not how to get in
        return False


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name and not name.startswith(("_common_metadata", "_metadata")) or name.endswith("._COPYING_")


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is it a folder, length, milliseconds) of what is in a folder."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                try:
                    s = e.stat()
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    continue
                yield e.name, e.is_dir(), s.st_size, s.st_mtime_ns // 1_000_000
    else:
        for i in system.get_file_info(fs.FileSelector(folder)):
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000


def _walked(spark: SparkSession, base: str) -> DataFrame:
    """(uri, length, modificationTime) of the files below a folder, which tasks list: the driver sees none of them.

    A task goes on into the folders that it finds until it has seen ENTRIES; those that are left are dealt out anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = system_of(base)
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["below", "length", "ms"])
        for batch in batches:
            seen, todo, rows = 0, batch.column(0).to_pylist(), []
            first = set(todo)
            while todo:
                folder = todo.pop()
                if seen > ENTRIES and folder not in first:
                    rows.append((folder, None, None))
                    continue
                for name, is_folder, length, ms in _entries(system, at + folder):
                    if _hidden(name):
                        continue
                    seen += 1
                    if is_folder:
                        todo.append(f"{folder}/{name}")
                    else:
                        rows.append((f"{folder}/{name}", length, ms))
                    if len(rows) >= ENTRIES:
                        yield told(rows)
                        rows = []
            yield told(rows)

    found, todo = [], local_table(spark, [("",)], "below string")
    while True:
        rows = written(todo.mapInArrow(run, "below string, length long, ms long"), "listed")
        found.append(rows.where("length is not null"))
        todo = rows.where("length is null").select("below")
        left = todo.count()
        if not left:
            break
        todo = todo.repartition(min(left, 4 * spark.sparkContext.defaultParallelism))
    return reduce(DataFrame.unionByName, found).select(F.concat(F.lit(base), "below").alias("uri"), "length", F.timestamp_millis("ms").alias("modificationTime"))


def with_contents(files: DataFrame, root: str, value: str = "content", by: str | None = None) -> DataFrame:
    """files(uri, length, ...) below root with the bytes of each, or with value="digest" their SHA-256; tasks read them, about as many bytes and files each.

    by: a column in whose order the files are read, within tasks and from task to task, so that what is in them need not be sorted.
    """
    spark = files.sparkSession
    base = qualified(spark, root)
    if not _by_tasks(base):
        told = F.col("content") if value == "content" else F.sha2("content", 256).alias("digest")
        some = few(files.select("uri"))
        rows = files.join(opened(spark, [base] if some is None else [r[0] for r in some]).select(F.col("path").alias("uri"), told), "uri").select(*files.columns, value)
        return rows if by is None else rows.orderBy(by)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(min(n, 4 * spark.sparkContext.defaultParallelism), n // TASK_FILES, size // TASK_BYTES, 1)
    at_uri, names = files.columns.index("uri"), [*files.columns, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        system, at = system_of(base)
        for batch in batches:
            first, texts, held = 0, [], 0
            for i, uri in enumerate(batch.column(at_uri).to_pylist()):
                path = at + uri[len(base) :]
                if isinstance(system, fs.LocalFileSystem):
                    with open(path, "rb") as f:
                        text = f.read()
                else:
                    with system.open_input_stream(path) as f:
                        text = f.read()
                texts.append(text if value == "content" else hashlib.sha256(text).hexdigest())
                held += len(text)
                if held >= BATCH_BYTES or len(texts) >= BATCH_ROWS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(texts, pa.binary() if value == "content" else pa.string())], names)
                    first, texts, held = i + 1, [], 0

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    files = files.repartition(tasks) if by is None else files.repartitionByRange(tasks, by).sortWithinPartitions(by)
    return files.mapInArrow(run, f"{kinds}, {value} {'binary' if value == 'content' else 'string'}")


def listing(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(uri, path, whole, length, modified) of the files below root that a pattern includes and none excludes. No file is read.

    Exclusion patterns match the path below root or, with anything before them, the whole path. only: the files of these
    uris. Tasks list the folders; the driver does so for ``only`` and for stores that only Spark reaches.
    """
    base = qualified(spark, root)
    plain = re.sub(_SCHEME, "/", base)
    files = _walked(spark, base) if only is None and _by_tasks(base) else opened(spark, [base] if only is None else only).withColumnRenamed("path", "uri")
    files = files.withColumn("whole", F.regexp_replace("uri", _SCHEME, "/"))
    files = files.where(F.startswith("whole", F.lit(plain + "/"))).withColumn("path", F.substr("whole", F.lit(len(plain) + 2)))
    wanted = F.lit(False)
    for g in include:
        wanted = wanted | F.col("path").rlike(glob_regex(g))
    for g in exclude or []:
        wanted = wanted & ~F.col("path").rlike(fnmatch_regex(g)) & ~F.col("whole").rlike(fnmatch_regex(f"*{g}"))
    return files.where(wanted).select("uri", "path", "whole", "length", F.col("modificationTime").alias("modified"))


def extension_of(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan(
    spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None, source_id: str = "", entrypoints: list[str] | None = None, latin: bool = True, only: list[str] | None = None,
    extensions: list[str] | None = None, in_order: bool = False,
) -> DataFrame:
    """(source_id, path, content, modified, is_entrypoint, extension, error) of the files of a listing(), or of those with one of the extensions.

    Files that can't be decoded have a null content and say so in error. Order is by path where it matters: rows carry their path, or with in_order come by it.
    """
    text = decoded(F.col("content"), latin)
    found = listing(spark, root, include, exclude, only)
    found = found if extensions is None else found.where(extension_of("path").isin(extensions))
    found = with_contents(found.drop("whole"), root, by="path" if in_order else None)
    return found.select(
        F.lit(source_id).alias("source_id"), "path", text.alias("content"), F.col("modified").cast("timestamp_ntz").alias("modified"), F.col("path").isin(list(entrypoints or [])).alias("is_entrypoint"),
        extension_of("path").alias("extension"), F.when(text.isNull(), F.lit("not UTF-8")).alias("error"),
    )


def write_files(rows: DataFrame, root: str) -> int:
    """Writes each of rows(path, content) as a file below root, by the executors, and deletes those whose content is null; how many rows there were.

    A task that is tried again writes the same files again. Paths are distinct and relative.
    """
    base = qualified(rows.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = system_of(base)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = f"{at}/{path}"
                if content.is_valid:
                    if (folder := whole.rsplit("/", 1)[0]) not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    with system.open_output_stream(whole) as out:
                        out.write(content.as_buffer())
                elif system.get_file_info(whole).type != fs.FileType.NotFound:
                    system.delete_file(whole)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
