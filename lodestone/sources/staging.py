"""Intermediate tables in the folder that a cluster shares, which cut long lineages and outlive any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder in local mode, else one in the warehouse if that is on a shared file system; ValueError if it isn't."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "")
        if spark.sparkContext.master.split("[")[0] == "local":
            path = tempfile.mkdtemp(prefix="lodestone-")
        elif "://" in warehouse and not warehouse.startswith("file:"):
            path = warehouse.rstrip("/") + "/_staging"
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df, written and read again."""
    path = f"{folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
