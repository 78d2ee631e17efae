"""Comparing runs of a benchmark with a manifest of baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def best_runs(manifest: DataFrame, runs: DataFrame, keys: list[str], prompt: str = "prompt") -> DataFrame:
    """manifest with the columns of its best run: equal keys, prompts equal with null as empty; the most cases, then the latest wins. Without a run the columns are null."""
    order = F.struct("case_count", "created_at", "run_id")
    picked = runs.withColumn("_p", F.coalesce(prompt, F.lit(""))).groupBy(*keys, "_p").agg(F.max_by(F.struct(*[c for c in runs.columns if c not in keys and c != prompt]), order).alias("run"))
    left = manifest.withColumn("_p", F.coalesce(prompt, F.lit("")))
    return left.join(picked, [*keys, "_p"], "left").drop("_p").select(*manifest.columns, "run.*")


def same_benchmark(runs: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """runs with `comparable`: whether their benchmark keys equal those of reference, one row; without one nothing compares."""
    one = reference.limit(1).select(*(F.col(k).alias(f"ref_{k}") for k in keys), F.lit(True).alias("_there"))
    both = runs.join(F.broadcast(one), F.lit(True), "left")
    equal = F.col("_there") & F.col("run_id").isNotNull()
    for k in keys:
        equal = equal & F.col(k).eqNullSafe(F.col(f"ref_{k}"))
    return both.withColumn("comparable", F.coalesce(equal, F.lit(False))).drop("_there", *(f"ref_{k}" for k in keys))


def status(expected: Column | int) -> Column:
    """planned, incomplete or measured, of a run's case_count and errors."""
    expected = F.lit(expected) if isinstance(expected, int) else expected
    n, errors = F.coalesce("case_count", F.lit(0)), F.coalesce("errors", F.lit(0))
    return F.when(F.col("run_id").isNull(), "planned").when((errors > 0) | (n != expected), F.format_string("incomplete (n=%d/%d, errors=%d)", n, expected, errors)).otherwise(F.format_string("measured (n=%d)", n))


def deltas(runs: DataFrame, reference: DataFrame, metric: str) -> DataFrame:
    """runs (comparable among their columns) with `delta`, formatted, of the metric against the one reference row."""
    ref = reference.limit(1).select(F.col(metric).alias("_ref"))
    return runs.join(F.broadcast(ref), F.lit(True), "left").withColumn("delta", T.delta(metric, "_ref", F.col("comparable"))).drop("_ref")


def pending(cases: DataFrame, previous: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that an earlier run did not do."""
    return cases.join(previous.select(key), key, "left_anti")


def equal_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: only_a, only_b, equal."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    one = left.join(right, key, "left_anti").agg(F.count("*").alias("only_a"))
    two = right.join(left, key, "left_anti").agg(F.count("*").alias("only_b"))
    return one.crossJoin(two).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
