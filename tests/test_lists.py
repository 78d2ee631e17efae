"""Dense search over clustered lists against all products."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lists, retrieval
from lodestone.sources.segments import Segments
from lodestone.sources.staging import staged


def vectors(spark, n=600, topics=12, dims=8, seed=1):
    rnd = np.random.default_rng(seed)
    means = rnd.normal(size=(topics, dims)) * 4
    x = means[rnd.integers(0, topics, n)] + rnd.normal(size=(n, dims)) * 0.3
    x[10:14] = x[10]  # equal scores
    return [(i, v, f"s{i % 3}") for i, v in enumerate(x.tolist())]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.select("query_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("k, part, block", [(1, 512, 64), (5, 16, 3), (700, 50, 64)])
def test_equals_all_products_and_skips_lists(spark, monkeypatch, k, part, block):
    monkeypatch.setattr(lists, "PART", part)
    monkeypatch.setattr(lists, "BLOCK", block)
    data = vectors(spark)
    table = spark.createDataFrame([*data, (900, None, "s0"), (901, [], "s0"), (902, [float("nan")] * 8, "s0"), (903, [None] * 8, "s0")], "doc_id long, vector array<double>, source string")
    asked = spark.createDataFrame([(i, v) for i, v, _ in data[:40]] + [(99, None)], "query_id long, vector array<double>")
    made, placed = (staged(t.withColumn("segment", F.lit(0))) for t in lists.build(table))
    want = rows(retrieval.top_hits(retrieval.dense(asked.filter("vector is not null"), spark.createDataFrame(data, "doc_id long, vector array<double>, source string")), k))
    assert rows(lists.search(asked, made, placed, k, staged)) == want
    if k == 5:
        theta = spark.createDataFrame([(q, s) for q, r, _, s in want if r == k], "query_id long, theta double")
        n = lists.probed(asked.filter("vector is not null"), made, k, theta)
        assert n < 40 * made.count() / 3  # two thirds of the lists and more are not looked into
        one_source = rows(lists.search(asked, made, placed.filter("source = 's1'"), k, staged))
        assert one_source == rows(retrieval.top_hits(retrieval.dense(asked.filter("vector is not null"), spark.createDataFrame(data, "doc_id long, vector array<double>, source string"), ["s1"]), k))


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "doc_id long, vector array<double>")
    made, placed = (t.withColumn("segment", F.lit(0)) for t in lists.build(none))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert lists.search(asked, made, placed, 3, staged).count() == 0
    made, placed = (t.withColumn("segment", F.lit(0)) for t in lists.build(spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vector array<double>")))
    assert lists.search(asked.limit(0), made, placed, 3, staged).count() == 0
    assert rows(lists.search(asked, made, placed, 3, staged)) == [(1, 1, 1, 1.0)]


def test_segments_with_vectors(spark, tmp_path):
    data = vectors(spark, 200)
    random.Random(2).shuffle(data)
    schema = "chunk_id long, vector array<double>, source string, text string"
    store = Segments(spark, str(tmp_path / "i"))
    store.upsert(spark.createDataFrame([(i, v, s, f"word{i}") for i, v, s in data[:150]], schema))
    store.upsert(spark.createDataFrame([(i, [x + 1 for x in v], s, f"word{i}") for i, v, s in data[100:]], schema))
    store.delete(spark.createDataFrame([(i,) for i, _, _ in data[:20]], "chunk_id long"))
    last = spark.createDataFrame([(i, v, s) for i, v, s in data[20:100]] + [(i, [x + 1 for x in v], s) for i, v, s in data[100:]], "doc_id long, vector array<double>, source string")
    asked = spark.createDataFrame([(i, f"word{i}", v) for i, v, _ in data[::10]] + [(777, "word7 word8", None)], "query_id long, query string, vector array<double>")
    want = retrieval.dense(asked.filter("vector is not null"), last)
    assert rows(store.dense(asked, 6)) == rows(retrieval.top_hits(want, 6))
    both = retrieval.hybrid(store.search(asked), want)
    assert rows(store.hybrid(asked)) == rows(both) and both.filter("query_id = 777").count() == 2


@pytest.mark.parametrize("cut", [None, ["s0", "s2"]])
def test_sample_is_drawn_where_rows_lie(spark, monkeypatch, cut):
    """the tasks together send about SAMPLE vectors to the driver, not SAMPLE each."""
    monkeypatch.setattr(lists, "SAMPLE", 100)
    table = spark.createDataFrame(vectors(spark, 2000), "doc_id long, vector array<double>, source string").repartition(20)
    table = table.filter(F.col("source").isin(cut)) if cut else table
    asked, one, two, n = [], lists.drawn(table, table.count()), lists.drawn(table.repartition(3), table.count()), 0
    assert one == two and 50 < len(one) <= 100
    monkeypatch.setattr(type(table), "orderBy", lambda self, *a, **b: asked.append(a) or self.sort(*a, **b))
    assert len(lists.centres(table)) > 10 and not asked  # no order with a limit, whose rows meet in the driver


def test_sample_of_rows_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(lists, "SAMPLE", 10)
    table = spark.createDataFrame([(5, [float(i), 1.0]) for i in range(300)], "doc_id long, vector array<double>")
    assert 1 <= len(lists.centres(table)) <= 10


def test_candidates_of_many_facts(spark, monkeypatch):
    """the step of semantic_candidates, with more queries than are broadcast, against all products; without an order with a limit."""
    from lodestone.operators import benchmark

    monkeypatch.setattr(lists, "SAMPLE", 60)
    table = spark.createDataFrame(vectors(spark, 400), "doc_id long, vector array<double>, source string").repartition(8)
    asked = table.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    pairs = lambda hits: sorted(map(tuple, benchmark.semantic(hits.select(F.col("query_id").alias("fact_id"), F.col("doc_id").alias("chunk_id"), "score"), 8).collect()))
    ordered = []
    monkeypatch.setattr(type(table), "orderBy", lambda self, *a, **b: ordered.append(a) or self.sort(*a, **b))
    got = pairs(retrieval.dense_top(asked, table, 9, block=3))
    assert got == pairs(retrieval.top_hits(retrieval.dense(asked, table), 9)) and not ordered


def test_neither_side_of_lists_is_broadcast(spark):
    """queries with their vectors in many lists went through the driver as a broadcast, since a shuffle compresses them."""
    table = spark.createDataFrame(vectors(spark, 300), "doc_id long, vector array<double>, source string")
    made, placed = (staged(t.withColumn("segment", F.lit(0))) for t in lists.build(table))
    asked = table.select(F.col("doc_id").alias("query_id"), "vector")
    both = lists.scored(lists.probes(asked, made, 5, True), placed, 5, 300)
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
