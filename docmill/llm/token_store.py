"""Token ids of documents as one id array in files, with Elias-Fano coded boundaries.

Documents are dealt in ranges of their ids and sorted; each task encodes its range and streams the ids into ``.ids`` files: nothing but
ids, 16 bits each where the vocabulary allows it, else 32, little-endian. Beside each stands an ``.idx`` file: a header, the ends of the
documents in the id array and the document ids, both as Elias-Fano codes with select structures, so that a reader finds the i-th
document, or the one of an id, without a table of 64-bit offsets. The names of files that count are committed by Spark as a
manifest; a file that isn't in it was left by a task that was tried again. Where a file's ids begin among all is the sum of the
files before it, in the manifest.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.worker import released
from docmill.llm.eliasfano import EliasFano
from docmill.llm.encoder import encoder
from docmill.llm.warc import place_of
from docmill.plans.shared import bounded_batches, shared_path

MAGIC = b"DMTOKEN1"
MANIFEST = "_manifest"
#: Ids and documents after which a file ends.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 22
#: Ids and documents that are read at once.
PIECE, BLOCK = 1 << 20, 1 << 12


def with_ends(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with the end id behind each document, and the new lengths."""
    if not len(lengths):
        return ids, lengths
    return np.insert(ids, np.cumsum(lengths), end), lengths + 1


class Shard:
    """An open ``.ids`` file with its index: documents by their place or their id, read alone."""

    def __init__(self, uri: str):
        self.store, self.path = place_of(uri)
        with self.store.open_input_stream(self.path.removesuffix(".ids") + ".idx", compression=None) as f:
            data = f.read()
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError(f"no token index: {uri}")
        n = int.from_bytes(data[len(MAGIC) : len(MAGIC) + 4], "little")
        at = len(MAGIC) + 4 + n
        told = json.loads(data[len(MAGIC) + 4 : at])
        self.kind, self.docs, self.unnamed = np.dtype(told["ids"]), told["documents"], told["without_id"]
        self.ends, at = EliasFano.from_bytes(data, at)
        self.names, at = EliasFano.from_bytes(data, at)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by one read of their range."""
        first, last = self.bounds(i)
        with self.store.open_input_file(self.path) as f:
            f.seek(first * self.kind.itemsize)
            return np.frombuffer(f.read((last - first) * self.kind.itemsize), self.kind)

    def find(self, doc_id: int) -> range:
        """The places of the documents that have the id."""
        return range(self.unnamed + self.names.find(doc_id), self.unnamed + self.names.find(doc_id + 1))

    def blocks(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """(document ids, bounds of them and of the next) for some documents at a time, in order: one of any length, or more of together up to PIECE ids."""
        i = 0
        while i < self.docs:
            j = min(self.docs, i + BLOCK)
            cuts = np.concatenate(([self.bounds(i)[0]], self.ends.slice(i, j)))
            j = i + max(1, int(np.searchsorted(cuts, cuts[0] + PIECE, "right")) - 1)
            nameless = max(0, min(j, self.unnamed) - i)
            names = [None] * nameless + self.names.slice(max(0, i - self.unnamed), max(0, j - self.unnamed)).tolist()
            yield names, cuts[: j - i + 1]
            i = j


def _index(kind: np.dtype, unnamed: int, names: np.ndarray, ends: np.ndarray) -> bytes:
    told = json.dumps({"ids": kind.str, "documents": len(ends), "without_id": unnamed}).encode()
    return MAGIC + len(told).to_bytes(4, "little") + told + EliasFano.encode(ends).to_bytes() + EliasFano.encode(names).to_bytes()


_FILES = "file string, task int, piece int, documents long, ids long, bytes long"


def _write(folder: str, tokenizer: str, end: int, most_ids: int, most_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes sorted batches (doc, text) and gives (file, task, piece, documents, ids, bytes) of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place_of(folder)
        task, done = TaskContext.get().partitionId(), []
        code, out, name, ids, docs = encoder(tokenizer), None, "", 0, 0
        names: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        unnamed = 0

        def close() -> None:
            nonlocal out
            out.close()
            out = None
            index = _index(code.kind, unnamed, np.concatenate(names), np.cumsum(np.concatenate(lengths)))
            with store.open_output_stream(f"{path}/{name}.idx", compression=None) as f:
                f.write(index)
            done.append((f"{name}.ids", task, len(done), docs, ids, ids * code.kind.itemsize + len(index)))

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    name = f"part-{task:05d}-{uuid.uuid4().hex}"
                    out, ids, docs, unnamed = store.open_output_stream(f"{path}/{name}.ids", compression=None), 0, 0, 0
                    names, lengths = [], []
                found, each = with_ends(*code.encode(batch.column(1)), end)
                out.write(found.astype(code.kind, copy=False).tobytes())
                names.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                lengths.append(each)
                ids, docs, unnamed = ids + len(found), docs + len(each), unnamed + batch.column(0).null_count
                if ids >= most_ids or docs >= most_docs:
                    close()
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.close()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["file", "task", "piece", "documents", "ids", "bytes"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end: int = 0, most_ids: int = FILE_IDS, most_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the ids of all documents to the folder path, in ascending order of their ids, and gives (file, task, piece, documents, ids, bytes).

    Each text, however long, is encoded whole by the tokenizer in the given file, without special tokens, and the end id follows. Null
    and empty texts have the end id only. Document ids are longs; rows with a null id come first, and rows that share an id stand
    side by side, in the order of a hash of their text; each counts. They are dealt by id, hash and place in the input, so that
    not even equal rows meet in one task. A file ends with the batch by which it has that many ids or documents. No rows: no files. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc", "h", "place").sortWithinPartitions("doc", "h", "place").select("doc", "text")
    with bounded_batches(spark):
        files = rows.mapInArrow(released(_write(path, tokenizer, end, most_ids, most_docs)), _FILES)
        files.write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return spark.read.schema(_FILES).parquet(f"{path}/{MANIFEST}")


def _read(with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                with shard.store.open_input_stream(shard.path, compression=None) as f:
                    for docs, cuts in shard.blocks():
                        ids = np.frombuffer(f.read(int(cuts[-1] - cuts[0]) * shard.kind.itemsize), shard.kind).astype("<u4")
                        if len(ids) != cuts[-1] - cuts[0]:
                            raise ValueError(f"{uri} ends before its last document")
                        view, at = memoryview(ids).cast("B"), (4 * (cuts - cuts[0])).tolist()
                        crc = [zlib.crc32(view[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                        found = [pa.array(docs, pa.int64()), pa.array(cuts[:-1] + base), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                        if with_ids:
                            found.append(pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(found, names)

    return run


def read_tokens(spark: SparkSession, path: str, ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of the documents in a folder that write_tokens() wrote; each file is read by one task.

    start is how many ids all documents before it have; n_tokens counts the end id; ids_crc32 is over the ids as little-endian unsigned
    32-bit numbers. Documents are found by their boundaries, some at a time, so that a task holds one document or a piece of the file.
    """
    files = spark.read.schema(_FILES).parquet(f"{path}/{MANIFEST}")
    n = files.count()
    before = Window.orderBy("task", "piece").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.concat(F.lit(f"{path}/"), "file").alias("file"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    kind = "doc long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return files.repartition(max(1, n)).mapInArrow(released(_read(ids)), kind).withColumnRenamed("doc", id_col)


def store_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What read_tokens() gives for documents that write_tokens() has written to the shared folder."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return read_tokens(docs.sparkSession, path, id_col=id_col)
