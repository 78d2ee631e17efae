"""Keep a search index up to date with a growing folder of documents.

    python -m jobs.index_documents --documents PATH --index PATH --checkpoint PATH [--config jobs/index_documents.json]

Reads the Parquet files of a folder as a stream and takes those that no earlier run took; the checkpoint knows which. Each batch of files is one segment of the index: of rows that share an id the one in the newest file holds, and
it replaces what older segments have of that id. A batch that failed is taken again and writes its segment again; a run without new files changes nothing. Index and checkpoint belong together.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config, session
from lodestone.sources.segments import Segments

DEFAULTS = {"id": "doc_id", "text": "text", "source": "source", "max_files_per_batch": 64}


def pattern(path: str) -> str:
    """The path as a pattern that it alone matches: a file stream takes a pattern for a single file, too, where a plain path has to be a folder."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[]{}") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, settings: dict | None = None) -> Segments:
    """Take the new files, wait for the end, and return the index. A null text has no terms; rows without an id are left out; other columns are ignored."""
    own = {**DEFAULTS, **(settings or {})}
    store = Segments(spark, index)
    schema = spark.read.parquet(documents).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", own["max_files_per_batch"]).parquet(pattern(documents))
    file = [F.col("_metadata.file_modification_time").alias("written_at"), F.col("_metadata.file_path").alias("file")]
    source = F.col(own["source"]) if own["source"] in schema.names else F.lit("")
    rows = files.select(F.col(own["id"]).alias("chunk_id"), F.col(own["text"]).cast("string").alias("text"), source.cast("string").alias("source"), *file)

    def indexed(batch: DataFrame, number: int) -> None:
        store.upsert(batch, number, newest=[F.col("written_at").desc(), F.col("file").desc()])

    stream = rows.writeStream.foreachBatch(indexed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    taken = [p for p in stream.recentProgress if p.numInputRows]
    for p in taken:
        LOG.info("read batch %s: %s rows of %s", p.batchId, p.numInputRows, documents)
    new = {p.batchId for p in taken}
    for t in sorted(store.totals().collect(), key=lambda t: t["segment"]):
        if t["segment"] in new:
            LOG.info("wrote segment %s of %s: %s documents, of which %s replace older ones", t["segment"], index, t["n"], t["n_replaced"])
    if not taken:
        LOG.info("read nothing new of %s; wrote nothing", documents)
    return store


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "index", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    spark = session("index_documents")
    try:
        run(spark, given.documents, given.index, given.checkpoint, config(spark, given.config, DEFAULTS) if given.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
