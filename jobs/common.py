"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.sources.files import read_text

log = logging.getLogger("docmill.jobs")


def settings(spark: SparkSession, config: str, known: dict) -> dict:
    """The values of a JSON file over those known; names that aren't known are refused."""
    found = json.loads(read_text(spark, config))
    if unknown := sorted(set(found) - set(known)):
        raise ValueError(f"{config}: unknown settings {', '.join(unknown)}")
    return known | found


def main(name: str, about: str, run: Callable[..., DataFrame], known: dict) -> None:
    """Runs a job from the command line: --config names a JSON file, and options named as its settings come before it.

    The session is made here and ends here.
    """
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    parser.add_argument("--config", help="JSON file with any of the settings below")
    for key, value in known.items():
        parser.add_argument(f"--{key.replace('_', '-')}", dest=key, type=type(value) if value is not None else str, help=f"default: {value}")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = args.pop("config")
        chosen = settings(spark, config, known) if config else dict(known)
        chosen |= {k: v for k, v in args.items() if v is not None}
        if missing := [k for k, v in chosen.items() if v is None]:
            parser.error(f"no value for {', '.join(missing)}")
        run(spark, **chosen)
    finally:
        spark.stop()
