"""Ranked search by WAND against SQL, and its pruning against all scores."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from lodestone.llm import search, wand


def slowly(docs, items):
    """ORACLE's rows over rows of (doc_id, text) and (item_id, text)."""
    import pandas as pd

    duck = duckdb.connect()
    duck.register("d", pd.DataFrame({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]}))
    duck.register("b", pd.DataFrame({"item_id": [i for i, _ in items], "text": [t for _, t in items]}))
    duck.execute("create view documents as select doc_id::bigint as doc_id, text::varchar as text from d")
    duck.execute("create view benchmark as select item_id::bigint as item_id, text::varchar as text from b")
    return sorted(duck.sql("select item_id, rank, doc_id, score from (" + wand.ORACLE + ")").fetchall())


@pytest.mark.parametrize("shard", [3000, 1 << 22])
def test_equals_sql(spark, docs, rows, shard):
    items = [(i, r[1]) for i, r in enumerate(rows[:30])] + [(100, None), (101, ""), (102, "no-such-word"), (103, "la " * 5 + rows[1][1][:40])]
    index = search.build_index(docs, shard_bytes=shard).cache()
    got = wand.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.select("query_id", "rank", "doc_id", "score").collect())) == slowly([(r[0], r[1]) for r in rows], items)


def test_blocks_of_queries(spark, docs, rows, monkeypatch):
    items = [(i, r[1]) for i, r in enumerate(rows[:12])]
    asked, index = spark.createDataFrame(items, "item_id long, text string"), search.build_index(docs).cache()
    whole = sorted(map(tuple, wand.search(index, asked).collect()))
    monkeypatch.setattr(wand, "QUERY_TERMS", 50)
    assert sorted(map(tuple, wand.search(index, asked).collect())) == whole


def test_ties_and_repeats(spark):
    """Equal scores go by the smaller id, wherever the rows lie; rows that share an id are documents of their own, and items that share one are one query."""
    docs = spark.createDataFrame([(i, "same rare") for i in range(40, 0, -1)] + [(100, "same other"), (None, "rare rare"), (7, "same rare")], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "rare"), (1, "Rare"), (2, "same"), (None, "rare")], "item_id long, text string")
    got = sorted(map(tuple, wand.search(search.build_index(docs, shard_bytes=64), items).collect()))
    assert [(r[0], r[1], r[2]) for r in got if r[0] == 1] == [(1, i + 1, d) for i, d in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 8, 9])]
    assert len({r[3] for r in got if r[0] == 1}) == 1 and {r[0] for r in got} == {1, 2}


def test_what_all_hold_weighs_nothing(spark):
    docs = spark.createDataFrame([(i, "same" + " rare" * (i == 4)) for i in range(600)], "doc_id long, text string")
    got = wand.search(search.build_index(docs), spark.createDataFrame([(1, "same rare"), (2, "same")], "item_id long, text string"))
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in got.collect()] == [(1, 1, 4)]


def test_empty_and_odd_tables(spark, nothing, odd, docs):
    assert wand.search(search.build_index(nothing), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert wand.search(search.build_index(docs), nothing.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert wand.search(search.build_index(odd), odd.filter("doc_id < 3"), id_col="doc_id").count() == 30


def test_prunes_without_loss():
    rnd = np.random.default_rng(5)
    n = 20_000
    lists = []
    for share, weight in ((0.5, 3), (0.3, 40), (0.01, 3000), (0.002, 5000)):
        d = np.flatnonzero(rnd.random(n) < share)
        impact = rnd.integers(200_000, 900_000, len(d))
        lists.append(([*d.tolist(), wand._END], impact.tolist(), int(impact.max()), weight))
    scores = np.zeros(n, np.int64)
    for d, impact, _, weight in lists:
        scores[d[:-1]] += np.array(impact) * weight
    heap: list[tuple[int, int]] = []
    ids = random.Random(1).sample(range(n), n)
    scored = wand.best(lists, ids, heap, 10)
    want = sorted(((int(s), -ids[i]) for i, s in enumerate(scores) if s), reverse=True)[:10]
    assert sorted(heap, reverse=True) == want
    assert scored < int((scores > 0).sum()) / 10  # nearly all documents with a term are skipped
