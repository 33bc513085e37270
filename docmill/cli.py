"""Command line: index, search, status, sources and serve."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docmill.plans.indexing import index_sources
from docmill.plans.tools import Engine
from docmill.server import serve
from docmill.sources import store
from docmill.sources.config import load_sources, sources_table


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("docmill", description=__doc__)
    p.add_argument("--config", default="sources.yaml")
    p.add_argument("--store", default="data")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("--source")
    two = sub.add_parser("search")
    two.add_argument("query")
    two.add_argument("--source")
    two.add_argument("--top-k", type=int, default=8)
    sub.add_parser("status")
    sub.add_parser("sources")
    sub.add_parser("serve")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("docmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "index":
        sources = [s for s in load_sources(spark, a.config) if a.source in (None, s.id)]
        first = 0 if a.source is None else store.last_seq(store.load_chunks(spark, a.store)) + 1
        store.save_chunks(index_sources(spark, sources, first), a.store, None if a.source is None else [a.source])
        Engine(store.load_chunks(spark, a.store), path=a.store).save()
    if a.command == "search":
        Engine.open(spark, a.store).search(a.query, a.source, a.top_k).show(a.top_k, 80)
    elif a.command == "serve":
        serve(Engine.open(spark, a.store, load_sources(spark, a.config)))
    elif a.command == "sources":
        sources_table(spark, load_sources(spark, a.config)).show(1000, 80)
    else:
        store.metadata(spark, a.store).show(1, False)
        store.load_chunks(spark, a.store).groupBy("source_id").agg(F.count("*").alias("chunk_count")).orderBy("source_id").show(1000, 80)
    return 0
