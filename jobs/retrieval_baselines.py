"""Measure configurations of lexical retrieval on a benchmark, side by side, and report them against one of their own.

    python -m jobs.retrieval_baselines --questions PATH --documents PATH --out PATH [--config jobs/retrieval_baselines.json]

A document that holds a question's text supports it in full, one that holds its first three words in part. Written, each partitioned by baseline: `hits` (the best documents of each question), `cases` (the metrics of each
question) and `report` (means over all questions and over classes of their length, with differences from the reference). Documents are scanned once for all baselines. A run replaces the partitions of its own
baselines and no others, so a repeated one changes nothing and a new baseline can be measured alone if the reference is named with it.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config, session
from lodestone.config import DEFAULTS as SETTINGS
from lodestone.functions import text as T
from lodestone.operators import benchmark, evaluation, retrieval

DEFAULTS = {
    "reference": "bm25", "baselines": [{"id": "bm25", "k1": 1.2, "b": 0.75}, {"id": "no-length", "k1": 1.2, "b": 0.0}, {"id": "presence", "k1": 0.1, "b": 0.75}], "top_k": 10, "word_classes": [20, 40],
    "question_id": "item_id", "question": "text", "document_id": "doc_id", "document": "text",
}
METRICS = ["hit_10", "recall_10", "ndcg_10", "mrr"]


def support(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, chunk_id, grade) of questions (case_id, query) over documents (chunk_id, body)."""
    start = F.array_join(F.slice(F.split("query", " "), 1, 3), " ")
    spans = F.array(F.struct(F.col("query").alias("span"), F.lit(2).alias("grade")), F.struct(start.alias("span"), F.lit(1).alias("grade")))
    asked = questions.filter("query is not null").select("case_id", F.explode(spans).alias("s")).select("case_id", "s.span", "s.grade")
    return benchmark.holding(documents, asked).groupBy("case_id", "chunk_id").agg(F.max("grade").alias("grade"))


def length_class(query: str, bounds: list[int]):
    """The class of a question's length in words: up to-20, up to-40, over-40, for bounds 20 and 40."""
    n, out = F.coalesce(T.count_tokens(query), F.lit(0)), F.lit(f"over-{bounds[-1]}")
    for bound in reversed(bounds):
        out = F.when(n <= bound, f"up to-{bound}").otherwise(out)
    return out


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("baseline").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, questions: str, documents: str, out: str, settings: dict | None = None) -> DataFrame:
    """The report (baseline, dimension, value, n, metrics, delta_mrr) of this run's baselines, as written. Questions without text or support count with zeros; rows without an id are left out. ValueError for ids that repeat or a
    reference that isn't among the baselines."""
    own = {**DEFAULTS, **(settings or {})}
    names = [b["id"] for b in own["baselines"]]
    if len(set(names)) < len(names) or own["reference"] not in names:
        raise ValueError("ids of baselines have to differ, and one has to be the reference")
    configs = {b["id"]: replace(SETTINGS, bm25_k1=float(b["k1"]), bm25_b=float(b["b"])) for b in own["baselines"]}
    asked = spark.read.parquet(questions).select(F.col(own["question_id"]).alias("case_id"), F.col(own["question"]).cast("string").alias("query")).filter("case_id is not null").dropDuplicates(["case_id"])
    texts = spark.read.parquet(documents).select(F.col(own["document_id"]).alias("chunk_id"), F.col(own["document"]).cast("string").alias("body")).filter("chunk_id is not null")
    LOG.info("read %s: %s questions; %s: %s documents; baselines: %s", questions, asked.count(), documents, texts.count(), ", ".join(names))

    ranks = retrieval.bm25_sweep_top(asked.filter("query is not null"), texts, configs, max(own["top_k"], 10), id_col="chunk_id", text_col="body", query_id="case_id")
    mine = F.col("baseline").isin(names)
    hits = _written(ranks.select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("chunk_id"), "rank", "score", F.col("config").alias("baseline")), f"{out}/hits").filter(mine)

    every = asked.select("case_id", length_class("query", own["word_classes"]).alias("length"), F.explode(F.array(*map(F.lit, names))).alias("baseline"))
    cases = _written(evaluation.score_rankings(every, hits.select("baseline", "case_id", "chunk_id", "rank"), support(asked, texts), by=("baseline",)), f"{out}/cases").filter(mine)

    groups = evaluation.metric_groups(cases, ["length"], METRICS, by=("baseline",))
    reference = groups.filter(F.col("baseline") == own["reference"]).select("dimension", "value", F.col("mrr").alias("_mrr"))
    report = groups.join(F.broadcast(reference), ["dimension", "value"], "left").withColumn("delta_mrr", F.round(F.col("mrr") - F.col("_mrr"), 6)).drop("_mrr")  # a row for each class
    report = _written(report.select("dimension", "value", "n", *METRICS, "delta_mrr", "baseline").coalesce(1), f"{out}/report").filter(mine)
    for name, n in sorted((r["baseline"], r["count"]) for r in hits.groupBy("baseline").count().collect()):
        LOG.info("wrote %s hits of baseline %s under %s", n, name, out)
    LOG.info("wrote %s rows of the report", report.count())
    return report.select("baseline", "dimension", "value", "n", *METRICS, "delta_mrr")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("questions", "documents", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    spark = session("retrieval_baselines")
    try:
        run(spark, given.questions, given.documents, given.out.rstrip("/"), config(spark, given.config, DEFAULTS) if given.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
