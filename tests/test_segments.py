"""The index of segments against an index of the rows that hold in the end."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.sources.segments import Segments, ranges

SCHEMA = "chunk_id long, text string, source string"
FIRST = [(1, "alpha beta", "a"), (2, "beta gamma gamma", "b"), (3, None, "a"), (4, "", None), (5, "alpha delta", "b"), (None, "lost", "a"), (5, "alpha alpha", "b")]
SECOND = [(2, "alpha epsilon", "b"), (6, "beta beta", "c"), (3, "gamma", "a")]


def hits(df):
    return sorted((r["query_id"], r["doc_id"], r["score"]) for r in df.collect())


def files(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return Segments(spark, str(tmp_path / "index"))


def test_nothing_is_there(spark, store):
    assert store.numbers() == [] and store.stats().first()["n"] == 0


def test_upserts_and_deletions_equal_the_last_rows(spark, store, tmp_path):
    assert store.upsert(spark.createDataFrame(FIRST, SCHEMA)) == 0
    old = files(store.folder)
    assert store.upsert(spark.createDataFrame(SECOND, SCHEMA)) == 1
    assert store.delete(spark.createDataFrame([(1,), (77,), (None,)], "chunk_id long")) == 2
    assert {p: t for p, t in files(store.folder).items() if p in old} == old  # files of older segments are as they were
    last = [(2, "alpha epsilon", "b"), (3, "gamma", "a"), (4, "", None), (5, "alpha delta", "b"), (6, "beta beta", "c")]
    rows = spark.createDataFrame(last, SCHEMA)
    assert sorted(tuple(r) for r in store.documents().select("chunk_id", "text", "source").collect()) == sorted(last)
    stats = store.stats().first()
    assert (stats["n"], stats["mean_dl"]) == (5, 7 / 5)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "zeta")], "query_id long, query string")
    want = hits(retrieval.bm25(asked, rows, id_col="chunk_id"))
    assert hits(store.search(asked)) == want and want
    assert hits(store.search(asked, sources=["b"])) == hits(retrieval.bm25(asked, rows, id_col="chunk_id", sources=["b"]))
    assert hits(store.merged(str(tmp_path / "merged")).search(asked)) == want
    # the last segment may be written again, an older one not; an id that comes back holds
    assert store.delete(spark.createDataFrame([(1,)], "chunk_id long"), 2) == 2 and hits(store.search(asked)) == want
    with pytest.raises(ValueError, match="older"):
        store.upsert(rows, 0)
    store.upsert(spark.createDataFrame([(1, "alpha beta", "a")], SCHEMA))
    assert store.stats().first()["n"] == 6 and 1 in {h[1] for h in hits(store.search(asked))}


def test_a_segment_without_totals_does_not_count(spark, store, monkeypatch):
    store.upsert(spark.createDataFrame(FIRST, SCHEMA))
    asked = spark.createDataFrame([(1, "alpha beta gamma epsilon")], "query_id long, query string")
    before = hits(store.search(asked))
    monkeypatch.setattr(Segments, "_count", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.upsert(spark.createDataFrame(SECOND, SCHEMA))
    monkeypatch.undo()
    assert store.numbers() == [0] and hits(store.search(asked)) == before
    assert store.upsert(spark.createDataFrame(SECOND, SCHEMA)) == 1
    rows = spark.createDataFrame([(1, "alpha beta", "a"), (2, "alpha epsilon", "b"), (3, "gamma", "a"), (4, "", None), (5, "alpha delta", "b"), (6, "beta beta", "c")], SCHEMA)
    assert hits(store.search(asked)) == hits(retrieval.bm25(asked, rows, id_col="chunk_id"))


def test_string_ids_and_empty_batches(spark, store):
    none = spark.createDataFrame([], "chunk_id string, text string")
    store.upsert(none)
    assert store.stats().first()["n"] == 0
    store.upsert(spark.createDataFrame([("x-1", "alpha")], "chunk_id string, text string"))
    store.upsert(none)
    assert hits(store.search(spark.createDataFrame([("q", "alpha")], "query_id string, query string")))[0][:2] == ("q", "x-1")


def test_a_frequent_term_is_spread_and_few_row_groups_are_read(spark, store):
    spark.conf.set("parquet.block.size", 16_384)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        hot = spark.range(6000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("common "), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(2)))).alias("text"))
        store.upsert(hot)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = store.postings().withColumn("file", F.input_file_name()).groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("term") == "common").alias("common")).collect()
    assert len(rows) > 3 and max(r["n"] for r in rows) < 0.6 * 18_000 and sum(r["common"] > 0 for r in rows) > 1
    asked = spark.createDataFrame([(1, "w1x77 w1x78")], "query_id long, query string")
    found = store.postings().filter(ranges(["w1x77", "w1x78"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(term,w1x77\)", plan)
    found.collect()
    scans = [m for m in _metrics(found._jdf.queryExecution().executedPlan(), "Scan parquet") if m]
    assert 0 < min(scans) < 18_000 / 3  # rows of the row groups that were read
    assert {h[1] for h in hits(store.search(asked))} == {77, 78}


def _metrics(node, name):
    """numOutputRows of the scans of a plan."""
    while "AdaptiveSparkPlan" in node.nodeName() or "QueryStage" in node.nodeName():
        node = node.executedPlan() if "Adaptive" in node.nodeName() else node.plan()
    found = [node.metrics().apply("numOutputRows").value()] if node.nodeName().startswith(name) else []
    children = node.children()
    return found + [x for i in range(children.size()) for x in _metrics(children.apply(i), name)]


@pytest.mark.parametrize("n", [0, 1, 5, 31, 32, 33, 500])
def test_ranges_hold_all_terms(spark, n):
    terms = [f"t{i * 7919 % 1000}" for i in range(n)]
    got = spark.createDataFrame([(t,) for t in [*terms, "a", "zz"]], "term string").filter(ranges(terms))
    assert {r["term"] for r in got.collect()} == set(terms)


def test_stored_postings_meet_by_document_before_they_are_multiplied(spark):
    """F6, F16, F17: each posting went through a shuffle once for every query that asks for its term."""
    from lodestone.operators import retrieval

    postings = spark.range(4000).selectExpr("id % 400 as doc_id", "concat('t', id div 400) as term", "1L as tf", "10L as dl", "'' as source").repartitionByRange(4, "term")
    asked = spark.range(30).selectExpr("id as query_id", "'t1 t2 t3 t4 t5 t6' as query")
    stats = spark.createDataFrame([(400, 10.0)], "n long, mean_dl double")
    got = retrieval.bm25_stored(asked, postings, stats)
    assert got.count() == 30 * 400
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan and "Exchange hashpartitioning(query_id" not in plan


def test_lists_are_made_where_documents_lie(spark, monkeypatch):
    """every posting of a segment went through two shuffles, one to be counted and one to be sorted."""
    monkeypatch.setattr(retrieval, "LISTED", 40)
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 7)
    monkeypatch.setattr(retrieval, "LIST_ROWS", 5)
    texts = [None if i % 9 == 4 else " ".join(f"w{(i * j) % (7 + i % 13)}" for j in range(i % 6)) for i in range(90)]
    docs = spark.createDataFrame([(f"d{i}", t, None if i % 5 else "s") for i, t in enumerate(texts)], "doc_id string, text string, source string").repartition(3).cache()
    lists = retrieval.listed(docs.select("doc_id", retrieval.T.token_list("text").alias("w"), "source"))
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    want = retrieval.postings(docs).join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "term", "tf", "dl", "source")
    assert sorted(map(str, retrieval.unlisted(lists).select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 100
    for part in lists.select(F.spark_partition_id().alias("p"), "term", "doc_id").groupBy("p").agg(F.collect_list("term").alias("t")).collect():
        assert 1 < sum(a >= b for a, b in zip(part["t"], part["t"][1:], strict=False)) + 1 < len(part["t"]) / 2  # runs in which terms ascend


def test_texts_do_not_meet_vectors(spark, store, tmp_path):
    """whole texts were shuffled to be joined with vectors, and again to look for ids that repeat."""
    docs = spark.createDataFrame([(i, f"alpha w{i}", "s") for i in range(20)], SCHEMA)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in (*range(5, 25), 24)], "chunk_id long, vector array<double>")
    assert store.upsert(docs, vectors=vectors) == 0
    asked = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "w3", None)], "query_id long, query string, vector array<double>")
    whole = Segments(spark, str(tmp_path / "whole"))
    whole.upsert(docs.join(vectors.distinct(), "chunk_id", "full"))
    want = sorted(map(tuple, whole.hybrid(asked).select("query_id", "doc_id", "score", "rank").collect()))
    shown = lambda s: sorted(map(tuple, s.hybrid(asked).select("query_id", "doc_id", "score", "rank").collect()))
    assert shown(store) == want and {h[1] for h in want} >= {24, 3} and store.count() == 25 and store.stats().first()["n"] == 20
    assert shown(store.merged(str(tmp_path / "merged"))) == want
    store.upsert(docs.limit(0), vectors=spark.createDataFrame([(24, [0.0, 0.0])], vectors.schema))
    assert 24 not in {r["doc_id"] for r in store.dense(asked.filter("query_id = 1"), 5).collect()}


@pytest.mark.parametrize("sources", [None, ["a"]])
def test_the_best_of_what_holds_are_scored_where_they_lie(spark, store, sources):
    """every posting met all queries that ask for its term, and all pairs were summed through a shuffle before the best were taken."""
    store.upsert(spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 7)) or None, "ab"[i % 2]) for i in range(80)], SCHEMA))
    store.upsert(spark.createDataFrame([(i, f"w1 w{i % 5} w2 w2", "a") for i in range(0, 80, 3)], SCHEMA))
    store.delete(spark.createDataFrame([(i,) for i in range(0, 80, 7)], "chunk_id long"))
    asked = spark.createDataFrame([(1, "w1 w2 w3 w1"), (2, "w10"), (3, "none"), (4, None), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")], "query_id int, query string")
    got = store.top(asked, 4, sources=sources)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.top_hits(store.search(asked, sources), 4).collect())) and got.count() == 12
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and "MapInArrow" in plan and plan.count("Exchange hashpartitioning(") == 1
    assert store.top(asked.limit(0), 4).count() == 0 == Segments(spark, store.folder + "-none").top(asked, 4).count()
