"""What has changed below the sources' folders since a manifest of their files was made.

Files are listed without being read. A file of the same length and time as in the manifest, of a source that is read in the same way, is kept;
of the others the digest tells whether they have changed, and these alone are read.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.chunking import CHUNKERS
from docmill.plans.shared import sized, written
from docmill.sources.config import Source
from docmill.sources.files import extension_of, listing, with_contents

FILES = "source_id string, path string, length long, modified timestamp, digest string, how string"


def how_read(source: Source) -> str:
    """A digest of what decides how a source's files become chunks."""
    return hashlib.sha256(json.dumps([[(a.type, a.config) for a in source.adapters], source.entrypoints, source.root], sort_keys=True, default=str).encode()).hexdigest()


def listed(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(source_id, path, uri, length, modified, how) of the files that an adapter of the sources takes. Nothing is read."""
    parts = []
    for s in sources:
        for adapter in s.adapters:
            if adapter.type == "compodoc":
                rows = listing(spark, s.root, [adapter.config.get("json_path", "documentation.json")], [])
            elif adapter.type in CHUNKERS:
                rows = listing(spark, s.root, s.include_globs, s.exclude_globs).where(extension_of("path").isin(list(CHUNKERS[adapter.type][0])))
            else:
                continue
            parts.append(rows.select(F.lit(s.id).alias("source_id"), "path", "uri", "length", "modified", F.lit(how_read(s)).alias("how")))
    empty = spark.createDataFrame([], "source_id string, path string, uri string, length long, modified timestamp, how string")
    return reduce(DataFrame.unionByName, parts, empty).distinct()


def changes(spark: SparkSession, sources: list[Source], manifest: DataFrame) -> DataFrame:
    """(source_id, path, uri, change, length, modified, digest, how), change being added, changed, removed or kept, as a written table.

    The manifest's files of other sources aren't looked at. Removed files have no uri and the manifest's digest.
    """
    known = manifest.where(F.col("source_id").isin([s.id for s in sources])).select("source_id", "path", *[F.col(c).alias(f"old_{c}") for c in ("length", "modified", "digest", "how")])
    both = listed(spark, sources).join(known, ["source_id", "path"], "full_outer")
    both = written(both.withColumn("look", F.col("uri").isNotNull() & ~(F.coalesce((F.col("length") == F.col("old_length")) & (F.col("modified") == F.col("old_modified")) & (F.col("how") == F.col("old_how")), F.lit(False)))), "listed-files")
    due = {r[0] for r in both.where("look").select("source_id").distinct().collect()}
    parts = [with_contents(both.where(F.col("look") & (F.col("source_id") == s.id)).select("uri", "length"), s.root, "digest").select("uri", "digest") for s in sources if s.id in due]
    texts = written(reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "uri string, digest string")).dropDuplicates(["uri"]), "digests")
    rows = both.join(sized(texts), "uri", "left").withColumn("digest", F.coalesce("digest", "old_digest"))
    change = F.when(F.col("uri").isNull(), "removed").when(F.col("old_digest").isNull(), "added").when((F.col("digest") != F.col("old_digest")) | (F.col("how") != F.col("old_how")), "changed").otherwise("kept")
    now = lambda c: F.coalesce(c, f"old_{c}").alias(c)
    return written(rows.select("source_id", "path", "uri", change.alias("change"), now("length"), now("modified"), "digest", now("how")), "changed-files")


def manifest_of(found: DataFrame) -> DataFrame:
    """The manifest after changes()."""
    return found.where("change <> 'removed'").select("source_id", "path", "length", "modified", "digest", "how")
