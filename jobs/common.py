"""What the jobs share: a configuration file read by Spark, a log, a session for the command line."""

from __future__ import annotations

import json
import logging

from pyspark.sql import SparkSession

LOG = logging.getLogger("lodestone.jobs")


def config(spark: SparkSession, path: str, known: dict) -> dict:
    """The JSON object in a file, which may be remote, over the defaults `known`. ValueError for a name that isn't among them."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return {**known, **given}


def session(name: str) -> SparkSession:
    """The command line's own session; master and resources are spark-submit's."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
