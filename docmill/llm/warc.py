"""WARC archives (version 1.1) with revisit records for repeated payloads.

Headers alone are grouped by payload digest, and repeats become revisit records that refer to the first response. Each task streams its
records into files of its own on shared storage, one gzip member a record, and returns their names; the table of names is committed
by Spark, and a file that isn't in it was left by a task that was tried again and doesn't count. Reading streams too: a task holds one
batch or one buffer, or, if payloads are asked for, one payload. Revisits are joined to their responses by digest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.worker import released
from docmill.plans.shared import bounded_batches, shared_path, sized, written

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE = "software: docmill\r\nformat: WARC File Format 1.1\r\n"
#: Payloads under this many bytes are always stored.
LEAST = 100
#: Bytes of records after which a file ends, and that are compressed or read at once.
FILE_BYTES, PIECE = 1 << 30, 1 << 20


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1)) if "://" in uri else (fs.LocalFileSystem(), uri)


def record_id(*parts: object) -> str:
    """A UUID made from a record's content, so that writing again gives the same one."""
    h = hashlib.md5("\n".join(str(p) for p in parts if p is not None).encode("utf-8", "replace"), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:]}>"


def _header(kind: str, fields: list[tuple[str, str | None]], length: int) -> bytes:
    """Nulls have no line. Line ends would end a header, so they are the only characters of a value that are encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in fields if v is not None), f"Content-Length: {length}"]
    return (CRLF.join(lines) + CRLF + CRLF).encode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: pa.Buffer | bytes, digest: str, original: int | None, original_url: str | None, again: bool, date: str) -> list:
    """The parts of a response, or of a revisit without its payload."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    fields = [("WARC-Record-ID", record_id(page_id, url, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if again:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, original_url, digest)), ("WARC-Refers-To-Target-URI", original_url), ("WARC-Refers-To-Date", date)]
    fields += [("X-Page-Id", None if page_id is None else str(page_id)), ("X-Page-Url", json.dumps(url) if url is not None and ("\r" in url or "\n" in url) else None), ("Content-Type", "application/http; msgtype=response")]
    body = b"" if again else payload
    return [_header("revisit" if again else "response", fields, len(http) + len(body)), http, body]


def _write(folder: str, date: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes batches (page_id, url, payload, digest, original, original_url, again) and gives (file, records, bytes) of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place_of(folder)
        done: list[tuple[str, int, int]] = []
        out, name, n, size = None, "", 0, 0

        def put(parts: list) -> int:
            pack, total = zlib.compressobj(6, zlib.DEFLATED, 31), 0
            for part in (*parts, b"\r\n\r\n"):
                view = memoryview(part)
                total += len(view)
                for i in range(0, len(view), PIECE):
                    out.write(pack.compress(view[i : i + PIECE]))
            out.write(pack.flush())
            return total

        try:
            for batch in batches:
                columns = [batch.column(i) for i in range(7)]
                for i in range(batch.num_rows):
                    if out is None:
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, n = store.open_output_stream(f"{path}/{name}", compression=None), 0
                        size = put([_header("warcinfo", [("WARC-Record-ID", record_id(name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], len(SOFTWARE)), SOFTWARE.encode()])
                    page, url, digest, original, original_url, again = (columns[k][i].as_py() for k in (0, 1, 3, 4, 5, 6))
                    size += put(record(page, url, columns[2][i].as_buffer(), digest, original, original_url, again, date))
                    n += 1
                    if size >= most:
                        out.close()
                        done.append((name, n, size))
                        out = None
            if out is not None:
                out.close()
                done.append((name, n, size))
        except BaseException:
            if out is not None:
                out.close()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))], ["file", "records", "bytes"])

    return run


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, digest, original, original_url, again): original is the page of the first response for revisits, else null.

    Firsts are found from headers. If there are few, each page looks its digest up; else revisits are decided among headers, and
    pages are joined to the decisions by id and digest, which no page that comes often makes hot.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = rows.where(F.octet_length("payload") >= LEAST).select("digest", "page_id", "url")
    firsts = heads.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = written(firsts.select("digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")), "first-responses")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    few = sized(firsts)
    if few is not firsts:
        planned = rows.join(few, "digest", "left").withColumn("again", again & (F.octet_length("payload") >= LEAST))
    else:
        found = heads.join(firsts, "digest").where(again).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "original", "original_url").distinct()
        planned = rows.join(written(found, "revisits"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").withColumn("again", F.col("original").isNotNull())
    one = lambda c: F.when(F.col("again"), F.col(c)).alias(c)
    return planned.select("page_id", "url", "payload", "digest", one("original"), one("original_url"), "again")


MANIFEST = "_manifest"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, date: str = "2026-01-01T00:00:00Z", most: int = FILE_BYTES) -> DataFrame:
    """Writes a WARC record for every row of pages to .warc.gz files in the folder path, and gives (file, records, bytes).

    Of records with equal payloads of at least 100 bytes, that with the least id is a response and the others are
    revisits of it; rows that repeat the least id are responses too. Null payloads are empty; rows with a null id are
    revisits if there is an id to refer to. Null URLs have no target header; others are written as they are, but for line ends.
    A file ends once it has ``most`` bytes of records. Other columns are ignored.
    """
    spark = pages.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    with bounded_batches(spark):
        files = plan_records(pages, id_col, url_col, html_col).mapInArrow(released(_write(path, date, most)), "file string, records long, bytes long")
        files.write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return spark.read.schema("file string, records long, bytes long").parquet(f"{path}/{MANIFEST}")


class _Reader:
    """Bytes of an archive as they are asked for, compressed or not."""

    def __init__(self, source):
        self.source, self.buffer, self.packed = source, b"", b""
        self.packed = source.read(PIECE)
        self.unpack = zlib.decompressobj(31) if self.packed[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.source.read(PIECE)
                if not self.packed:
                    return False
            if self.unpack is None:
                self.buffer, self.packed = self.buffer + self.packed, b""
                return True
            found = self.unpack.decompress(self.packed, PIECE)
            self.packed = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            if found:
                self.buffer += found
                return True

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end."""
        self.buffer = self.buffer.lstrip(b"\r\n")
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("an archive ends inside a header")
                return None
            self.buffer = self.buffer.lstrip(b"\r\n") if not self.buffer.strip() else self.buffer
        out, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError("an archive ends inside a record")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part


def read_records(source) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers, pieces of the block) of every record of an open archive, in order. What is left of a block is passed over."""
    reader = _Reader(source)
    while (head := reader.head()) is not None:
        lines = head.decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {lines[0][:40]!r}")
        fields = {k: v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
        block = reader.pieces(int(fields["Content-Length"]))
        yield fields, block
        for _ in block:
            pass


def body(block: Iterator[bytes]) -> Iterator[bytes]:
    """What follows the HTTP header of a block."""
    head = b""
    for part in block:
        head += part
        if (end := head.find(b"\r\n\r\n")) >= 0:
            yield head[end + 4 :]
            yield from block
            return


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "record_id", "refers_to_id", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = place_of(uri)
                out: list[list] = [[] for _ in names]
                held = 0
                with store.open_input_stream(path, compression=None) as source:
                    for fields, block in read_records(source):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        again, page, raw = fields["WARC-Type"] == "revisit", fields.get("X-Page-Id"), fields.get("X-Page-Url")
                        digest, told, size, parts = hashlib.sha256(), fields["WARC-Payload-Digest"].removeprefix("sha256:"), 0, []
                        for part in () if again else body(block):
                            digest.update(part)
                            size += len(part)
                            if with_payload:
                                parts.append(part)
                        if not again and digest.hexdigest() != told:
                            raise ValueError("a payload differs from its digest")
                        row = (None if page is None else int(page), fields.get("WARC-Target-URI") if raw is None else json.loads(raw), fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), told, None if again else size, b"".join(parts).decode("utf-8") if with_payload and not again else None)
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                        held += 300 + (size if with_payload else 0)
                        if held > PIECE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                            out, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, record_id, refers_to_id, payload_digest, payload_bytes, payload) of the responses and revisits in a folder.

    A folder that write_archives() wrote is read as its manifest says, any other as a whole. Revisits have no payload_bytes and
    payload of their own; payloads are read only if asked for. Each file is read by one task.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc*").load(path)
    files = files.where("length > 0").select("path")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        counted = sized(spark.read.schema("file string").parquet(f"{path}/{MANIFEST}"))
        files = files.withColumn("file", F.substring_index("path", "/", -1)).join(counted, "file", "left_semi").select("path")
    return files.mapInArrow(released(_read(payload)), "page_id long, url string, record_type string, record_id string, refers_to_id string, payload_digest string, payload_bytes long, payload string")


def resolve_revisits(found: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to): revisits joined to their original responses.

    Headers go by digest and record. Responses are one row for each referred record; of the side with many rows for one
    digest, the shuffle's large partitions can be split.
    """
    revisits = found.where("record_type = 'revisit'").select("page_id", "url", "payload_digest", "refers_to_id")
    responses = found.where("record_type = 'response'")
    heads = responses.where(F.col("payload_bytes") >= LEAST).select(F.col("payload_digest").alias("d"), F.col("record_id").alias("r"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes")).dropDuplicates(["d", "r"])
    joined = revisits.join(heads, (F.col("payload_digest") == F.col("d")) & (F.col("refers_to_id") == F.col("r")), "left")
    again = joined.select("page_id", "url", F.col("bytes").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return again.unionByName(responses.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What resolve_revisits() gives for archives of pages, written to the shared folder and read back."""
    path = shared_path(pages.sparkSession, "archives")
    write_archives(pages, path, id_col, url_col, html_col)
    found = written(read_archives(pages.sparkSession, path).drop("payload"), "headers")
    return resolve_revisits(found)
