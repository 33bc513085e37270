"""Helpers for plans of several jobs: shared storage for results in between, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes up to which a table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Rows that a plan may look at on the driver to choose what it reads.
FEW_ROWS = 10_000
#: Bytes up to which a scan may be dealt out anew.
SMALL_SCAN = 256 << 20

#: Rows and bytes of a batch of texts that goes to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: How large tables that are stored are written.
PACKED = {"compression": "zstd"}

_left: dict[str, SparkSession] = {}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once; a smaller setting of the session stays as it is."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what a Python worker holds at once while plans run inside; the session's settings come back at the end."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n, None) for n in names]
    small_batches(spark)
    try:
        yield
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="docmill-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docmill-{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a short lineage that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def packed(df: DataFrame, name: str) -> DataFrame:
    """written(), in fewer bytes."""
    return written(df, name, **PACKED)


def release(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path in _left:
            _delete(_left.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_left.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended
            return


def spread(scan: DataFrame) -> DataFrame:
    """A small scan of fewer partitions than the cluster has cores, dealt to that many; others as they are.

    Only a scan of at most SMALL_SCAN bytes, by the size of its files, is shuffled. For scans only: a plan with shuffles would run to
    count its partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_SCAN:
        return scan
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(scan: DataFrame) -> DataFrame:
    """A small scan dealt evenly to four tasks for each core, for work that is dear by the row; others as they are.

    However many partitions share the bytes of a file, the rows of a row group are one task's.
    """
    if int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_SCAN:
        return scan
    return scan.repartition(4 * scan.sparkSession.sparkContext.defaultParallelism)


def _width(kind: DataType, c: Column) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, ArrayType | MapType | StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is seen to have at most so many rows and bytes; otherwise joins shuffle."""
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0)).cast("long")
    n, found = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and found <= size else df


def few(df: DataFrame, most: int = FEW_ROWS) -> list | None:
    """The rows of df if they are at most that many, else None."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def local_table(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """A few rows as values inside the plan: projections and filters of them need no job."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], kind.type) for i, kind in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=pa.schema([f.with_nullable(True) for f in kinds])), schema)


def held(df: DataFrame) -> DataFrame:
    """A table of a few rows as values in the plan, so that it is worked out once; a larger one as it is."""
    rows = few(df)
    return df if rows is None else F.broadcast(local_table(df.sparkSession, rows, df.schema))


def kept_near(df: DataFrame, name: str) -> DataFrame:
    """A table that is read more than once: as values in the plan if it has a few rows, else written to the shared folder."""
    rows = few(df)
    return written(df, name) if rows is None else local_table(df.sparkSession, rows, df.schema)
