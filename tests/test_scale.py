"""Operators that once met in one task, in memory, or in all pairs: the same rows as slow versions, and plans without those."""

from __future__ import annotations

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import benchmark, evaluation
from lodestone.operators.common import in_order
from lodestone.sources.staging import staged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- quantiles ---


@pytest.mark.parametrize("splits", [2, 7, 1024])
def test_ranks_by_narrowing(spark, splits):
    rnd = random.Random(splits)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(700)], "b": [5.0] * 30, "c": [rnd.choice([0.0, -0.0, 1e300, -1e300, 1e-300, 3.5]) for _ in range(200)], "d": [2.0], "e": [1.7976931348623157e308, -1.7976931348623157e308, 0.1], None: [1.0, 2.0, 3.0, 4.0]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("a", None), ("f", None), ("a", float("nan"))]
    ranks = {"least": lambda n: F.lit(1), "middle": lambda n: F.floor((n + 1) / 2), "p95": lambda n: F.ceil(n * 0.95), "most": lambda n: n}
    got = {r["k"]: r for r in evaluation.at_ranks(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", ranks, splits).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        s = sorted(own)
        assert [got[g][c] for c in ranks] == [s[0], s[(len(s) + 1) // 2 - 1], s[math.ceil(len(s) * 0.95) - 1], s[-1]]


def test_latency_of_large_groups_equals_that_in_memory(spark):
    rnd = random.Random(4)
    rows = spark.createDataFrame([("xyz"[i % 3] if i % 7 else None, i, round(rnd.expovariate(0.1), 2) if i % 11 else None) for i in range(900)] + [("w", 0, None)], "k string, at int, v double")
    one, two = evaluation.latency(rows, ["k"], "v", "at"), evaluation.latency(rows, ["k"], "v", "at", in_memory=10)
    order = sorted(one.columns)
    assert sorted(map(str, one.select(order).collect())) == sorted(map(str, two.select(order).collect()))
    x = [r["v"] for r in rows.filter("k = 'x' and v is not null").collect()]
    assert two.filter("k = 'x'").first()["median_s"] == round(statistics.median(x), 6)
    assert "percentile" not in plan(two)


# --- numbering ---


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places_in_the_order_of_all_rows(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice("abc"), rnd.randint(0, 10_000), i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(6)
    got = in_order(df, ["g", F.col("o").desc(), "i"])
    assert [r["i"] for r in sorted(got.collect(), key=lambda r: r["at"])] == [i for _, _, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2]))]
    assert sorted(r["at"] for r in got.collect()) == list(range(n)) and "Window" not in plan(got)


@pytest.mark.parametrize("n, k", [(1, 1), (7, 3), (10, 10), (10, 25), (100, 7), (97, 13), (5, 0)])
def test_even_spread_has_no_window(spark, n, k):
    got = benchmark.even_spread(spark.range(n), "id", n, k)
    firsts = sorted({i * n // k for i in range(k)}) if k else []
    want = {x: at + 1 for at, x in enumerate(firsts + [x for x in range(n) if x not in firsts])}
    assert {r["id"]: r["place"] for r in got.collect()} == want and "Window" not in plan(got)


def test_case_assembly_has_no_window(spark):
    asked = [("natural", "q1?"), ("lexical", "q2?"), ("formal", "q3?")]
    rows = [(i, "multi" if i % 3 else "single", 2 + i % 2, asked) for i in range(50)]
    got = benchmark.assemble_cases(spark.createDataFrame(rows, "group_key int, multiplicity string, n_questions int, questions array<struct<style:string,query:string>>").repartition(4))
    want, no = [], 0
    for m in ("multi", "single"):
        for at, (key, _, n, _) in enumerate(r for r in rows if r[1] == m):
            for style, q in asked:
                if n == 3 or style != "lexical":
                    no += 1
                    want.append((f"ret_{no:03d}", f"{m}_{at + 1:03d}", key, m, style, q))
    assert sorted(map(tuple, got.collect())) == want and "Window" not in plan(got)


# --- spans and tokens ---


@pytest.mark.parametrize("most", [1, 40, 1_000_000])
def test_spans_equal_a_plain_search(spark, most):
    texts = [(1, "a red fox runs. A red fox"), (2, "fox"), (3, None), (4, ""), (5, "é red\nfox x"), (6, "aaaa")]
    spans = [("fox", 1), ("red fox", 2), ("a", 3), ("", 4), (None, 5), ("fox", 6), ("red\nfox", 7), ("é", 8), ("none such", 9), ("aa", 10), ("fox", 1)]
    got = benchmark.holding(spark.createDataFrame(texts, "chunk_id int, body string").repartition(3), spark.createDataFrame(spans, "span string, n int"), most)
    want = sorted({(c, n) for c, body in texts for span, n in spans if body and span and span in body})
    assert sorted((r["chunk_id"], r["n"]) for r in got.collect()) == want
    text = plan(got)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_span_texts_are_not_shuffled(spark):
    texts = spark.range(2000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("body of text "), "id").alias("body"))
    got = benchmark.holding(texts, spark.createDataFrame([("text 77", 1)], "span string, n int"))
    assert not re.search(r"Exchange[^\n]*body", plan(got)) and got.count() == 11


def test_no_spans(spark):
    assert benchmark.holding(spark.createDataFrame([(1, "x")], "chunk_id int, body string"), spark.createDataFrame([], "span string, n int")).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.72, 1.0])
def test_lexical_candidates_are_few_and_lose_nothing(spark, share):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(["common", "every", "other"] + [rnd.choice(words[: 40 if rnd.random() < 0.5 else 400]) for _ in range(30)]) for _ in range(120)]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None), (501, "")], "chunk_id int, text string")
    sets = {i: set(t.split()) - {"other"} for i, t in enumerate(texts)}
    asked = [(i, sorted(rnd.sample(sorted(sets[i]), 6)) + ["common", "every", "nowhere"]) for i in range(0, 120, 3)] + [(900, ["nowhere", "at", "all"]), (901, [])]
    facts = spark.createDataFrame(asked, "fact_id int, tokens array<string>")
    own = {r["chunk_id"]: set(r["s"] or ()) for r in chunks.select("chunk_id", T.token_set("text").alias("s")).collect()}
    want = sorted((f, c) for f, t in asked for c, s in own.items() if t and f != c and len(set(t) & s) / len(t) >= share)
    assert sorted(map(tuple, benchmark.lexical(facts, chunks, share).collect())) == want
    pairs, sharing = staged(benchmark.lexical_pairs(facts, chunks, share)).count(), sum(1 for f, t in asked for s in own.values() if set(t) & s)
    assert len(want) <= pairs and (share < 0.7 or pairs < sharing / 3)


def test_what_is_broadcast_is_measured_in_rows_and_bytes(spark):
    from lodestone.operators.common import fits

    rows = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t.x"), F.array(F.lit(None).cast("string")).alias("a"))
    assert fits(rows, 10) and not fits(rows, 9) and fits(rows, 10, 12_000) and not fits(rows, 10, 9_000) and fits(rows.limit(0), 0, 0)


# --- scores of documents ---


@pytest.mark.parametrize("name", ["citation_scores", "rerank_threshold_topk", "source_precision", "fusion_with_exclusion", "metrics_grouping_sets", "hit_at_k"])
def test_pairs_are_not_summed(spark, monkeypatch, name):
    """A sum for each pair of a question and a document that share a term: rows, shuffle and memory of a task grew with postings times questions."""
    from lodestone.operators import retrieval
    from lodestone.plans.catalog import QUERIES

    def never(*_, **__):
        raise AssertionError("pairs are summed")

    for f in ("bm25", "bm25_sweep", "_summed"):
        monkeypatch.setattr(retrieval, f, never)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_documents_of_a_batch_are_looked_up_in_parts(spark, monkeypatch):
    """Words of all documents of a batch, up to 10,000, were looked up at once."""
    from lodestone.operators import retrieval

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 7))) for i in range(60)] + [(99, None)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(q, f"w{q} w{q + 3}") for q in range(6)], "query_id int, query string")
    want = sorted(map(tuple, retrieval.top_hits(retrieval.bm25(asked, docs), 4).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 7)
    assert sorted(map(tuple, retrieval.bm25_top(asked, docs, 4).collect())) == want
