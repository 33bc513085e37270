"""Keeps the sections of a documentation site's pages up to date: a stream of page files into partitioned sections.

Crawls arrive as Parquet files of (page_id, url, html). Each run takes the files that no run before it has taken, turns their
pages into markdown, splits them into sections as the index does, and writes these to batch=N/bucket=B folders, N being the
stream's batch and B the first hex digit of the MD5 of the host, so that a site is read from one bucket. Spark's checkpoint is the
mark: a run that died is taken up at its batch, which overwrites its own folders and nothing else. Nothing that stands is
rewritten; of a page that comes again the last version counts, which is what current() reads.

    python -m jobs.page_feed --config jobs/page_feed.json
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import TERM, chunk_id, html_to_markdown, url_host, url_path, words
from docmill.operators.chunking.sections import kind_of_path, sections
from docmill.sources.files import exists
from jobs.common import log, main

SETTINGS = {"pages": None, "out": None, "checkpoint": None, "files_per_batch": 1000}
#: What tells versions of a page apart, of which the greatest counts: the stream's batch, the file's time, what the page says, and its row.
VERSION = ("batch", "modified", "digest", "file", "row")
SECTIONS = (
    "page_id long, url string, host string, path string, place int, id string, title string, anchor string, depth int, kind string, n_terms long, content string, removed boolean, "
    "modified timestamp, digest string, file string, row long, batch long, bucket string"
)


def sections_of(pages: DataFrame) -> DataFrame:
    """The sections of pages (page_id, url, html, modified, file, row), in the columns of SECTIONS less the batch.

    A page has one section at least, which says removed if its html is null. Null URLs have an empty host and path. A section's id
    is made from host, path and anchor, as a chunk's is. One scan; nothing is shuffled.
    """
    rows = pages.withColumns({"host": url_host("url"), "path": url_path("url"), "removed": F.col("html").isNull()})
    rows = rows.withColumn("digest", F.sha2(F.concat(F.coalesce(F.col("url"), F.lit("")), F.lit("\n"), F.coalesce(F.col("html"), F.lit(""))), 256))
    rows = rows.withColumns({"bucket": F.substring(F.md5("host"), 1, 1), "kind": kind_of_path(F.col("path"))})
    rows = rows.select("*", F.posexplode(sections(html_to_markdown("html"), "Introduction")).alias("place", "s")).select("*", "s.*")
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "host", "path", "place", chunk_id(F.col("host"), F.col("path"), F.coalesce(F.nullif("anchor", F.lit("")), F.lit("root"))).alias("id"), "title", "anchor", "depth", "kind",
        F.size(words("content", TERM)).cast("long").alias("n_terms"), "content", "removed", "modified", "digest", "file", "row", "bucket",
    )


def written_sections(spark: SparkSession, out: str) -> DataFrame:
    """All that stands in out; empty before anything was written."""
    return spark.read.schema(SECTIONS).parquet(out) if exists(spark, out) else spark.createDataFrame([], SECTIONS)


def writer(out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch's sections replace what the same batch wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        rows = sections_of(batch).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(out)
        there = written_sections(batch.sparkSession, out).where(F.col("batch") == number)
        n = there.agg(F.count("*").alias("sections"), F.count_if(F.col("place") == 0).alias("pages"), F.count_if((F.col("place") == 0) & F.col("removed")).alias("removed")).first()
        log.info("batch %d: %d pages (%d removed), %d sections written to %s", number, n["pages"], n["removed"], n["sections"], out)

    return write


def current(spark: SparkSession, out: str) -> DataFrame:
    """The sections of the last version of each page that isn't removed. Each page without an id counts.

    Last versions are told from narrow columns, a row for each page.
    """
    rows = written_sections(spark, out)
    last = rows.where("place = 0 and page_id is not null").groupBy(F.col("page_id").alias("p")).agg(F.max(F.struct(*VERSION, "removed")).alias("last"))
    same = [F.col(c).eqNullSafe(F.col(f"last.{c}")) for c in VERSION]
    known = rows.join(last.where("not last.removed"), [F.col("page_id") == F.col("p"), *same], "left_semi")
    return known.unionByName(rows.where("page_id is null and not removed")).drop("removed", *VERSION[1:])


def _either(path: str) -> str:
    """A pattern that only this path fits: file streams take folders, or patterns, of which a file may be the match."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() and not set("*?[{") & set(path) else path


def feed(spark: SparkSession, pages: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Takes the files below pages that are new to the checkpoint into out, waits for the stream to end, and gives current().

    pages is a folder of Parquet files, or one file; other columns than page_id, url and html are ignored, and so are empty files.
    Without a new file nothing is written.
    """
    kinds = "page_id long, url string, html string"
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", files_per_batch).parquet(_either(pages))
    stream = stream.select("page_id", "url", "html", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    query = stream.writeStream.foreachBatch(writer(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("%d new rows read from %s", read, pages)
    return current(spark, out)


if __name__ == "__main__":
    main("page_feed", __doc__.splitlines()[0], feed, SETTINGS)
