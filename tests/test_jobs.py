"""The jobs: growing input, repeated runs, runs that fail on the way."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import common, index_documents, retrieval_baselines
from lodestone.config import DEFAULTS, Settings
from lodestone.operators import retrieval

DOCS = "doc_id long, text string, source string, lang string"
HERE = Path(__file__).resolve().parent.parent


def written(spark, rows, path, name):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(path))
    return name


def held(store):
    return sorted(tuple(r) for r in store.documents().select("chunk_id", "text", "source").collect())


def test_only_new_files_are_taken(spark, tmp_path):
    docs, index, mark = (str(tmp_path / n) for n in ("docs", "index", "mark"))
    written(spark, [(1, "alpha beta", "a", "x"), (2, "beta", "b", None), (3, None, None, None), (None, "no id", "a", None)], docs, "one")
    store = index_documents.run(spark, docs, index, mark)
    assert held(store) == [(1, "alpha beta", "a"), (2, "beta", "b"), (3, None, None)] and store.numbers() == [0]
    index_documents.run(spark, docs, index, mark)
    assert store.numbers() == [0]
    written(spark, [(2, "gamma gamma", "b", None), (4, "alpha", "c", None)], docs, "two")
    store = index_documents.run(spark, docs, index, mark)
    assert held(store) == [(1, "alpha beta", "a"), (2, "gamma gamma", "b"), (3, None, None), (4, "alpha", "c")] and store.numbers() == [0, 1]
    last = [tuple(r) for r in store.totals().orderBy("segment").select("segment", "n", "n_replaced").collect()]
    assert last == [(0, 2, 0), (1, 2, 1)]  # a document without text counts nowhere
    asked = spark.createDataFrame([(1, "alpha gamma")], "query_id long, query string")
    rows = spark.createDataFrame([(i, t) for i, t, _ in held(store)], "doc_id long, text string")
    assert sorted(map(tuple, store.search(asked).collect())) == sorted(map(tuple, retrieval.bm25(asked, rows).collect()))


def test_a_failed_batch_is_taken_again(spark, tmp_path, monkeypatch):
    docs, index, mark = (str(tmp_path / n) for n in ("docs", "index", "mark"))
    written(spark, [(1, "alpha", "a", None)], docs, "one")
    index_documents.run(spark, docs, index, mark)
    written(spark, [(1, "beta", "a", None), (2, "gamma", "a", None)], docs, "two")
    count = index_documents.Segments._count
    monkeypatch.setattr(index_documents.Segments, "_count", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision"):
        index_documents.run(spark, docs, index, mark)
    monkeypatch.setattr(index_documents.Segments, "_count", count)
    store = index_documents.run(spark, docs, index, mark)
    assert held(store) == [(1, "beta", "a"), (2, "gamma", "a")] and store.numbers() == [0, 1]


def test_newest_file_wins_in_a_batch(spark, tmp_path):
    docs = str(tmp_path / "docs")
    written(spark, [(1, "zzz old", "a", None)], docs, "one")
    written(spark, [(1, "aaa new", "a", None)], docs, "two")
    store = index_documents.run(spark, docs, str(tmp_path / "index"), str(tmp_path / "mark"))
    assert held(store) == [(1, "aaa new", "a")] and store.numbers() == [0]


def test_a_single_file_and_small_batches(spark, tmp_path):
    docs = str(tmp_path / "docs")
    for i in range(3):
        written(spark, [(i, f"t{i}", "a", None)], docs, str(i))
    store = index_documents.run(spark, docs, str(tmp_path / "i1"), str(tmp_path / "m1"), {"max_files_per_batch": 1})
    assert store.numbers() == [0, 1, 2] and len(held(store)) == 3
    one = next(str(p) for p in Path(docs).glob("*.parquet"))
    assert len(held(index_documents.run(spark, one, str(tmp_path / "i2"), str(tmp_path / "m2")))) == 1


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"id": "key"}))
    assert common.config(spark, str(tmp_path / "c.json"), index_documents.DEFAULTS) == {**index_documents.DEFAULTS, "id": "key"}
    (tmp_path / "d.json").write_text(json.dumps({"idd": "key"}))
    with pytest.raises(ValueError, match="idd"):
        common.config(spark, str(tmp_path / "d.json"), index_documents.DEFAULTS)
    assert common.config(spark, str(HERE / "jobs/index_documents.json"), index_documents.DEFAULTS) == index_documents.DEFAULTS


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def small(spark, tmp_path):
    texts = ["red fox runs home", "red fox sleeps", "blue whale red fox runs", "green tea", None, "", "red " * 30 + "fox"]
    written(spark, [(i, t, "a", None) for i, t in enumerate(texts)] + [(None, "red fox runs", "a", None)], tmp_path / "docs", "d")
    asked = [(0, "red fox runs"), (1, "green tea"), (2, "no such thing here"), (3, None), (4, "red " * 25), (None, "red")]
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "asked"))
    return str(tmp_path / "asked"), str(tmp_path / "docs"), str(tmp_path / "out")


def test_baselines_are_measured_side_by_side(spark, small):
    report = retrieval_baselines.run(spark, *small)
    got = {(r["baseline"], r["dimension"], r["value"]): r for r in report.collect()}
    assert {k[1:] for k in got} == {("all", "all"), ("length", "up to-20"), ("length", "up to-40")} and len(got) == 9
    assert {r["n"] for k, r in got.items() if k[1] == "all"} == {5} and got["bm25", "length", "up to-40"]["n"] == 1
    assert all(r["delta_mrr"] == 0 for k, r in got.items() if k[0] == "bm25")
    cases = {(r["baseline"], r["case_id"]): r for r in spark.read.parquet(f"{small[2]}/cases").collect()}
    assert cases["bm25", 1]["mrr"] == cases["bm25", 1]["ndcg_10"] == 1.0 and cases["bm25", 0]["recall_10"] == 1.0 and cases["bm25", 2]["mrr"] == cases["bm25", 3]["mrr"] == 0.0
    # repeated, and with another baseline: what stands there stays as it is
    rows, old = sorted(map(tuple, report.collect())), files(small[2])
    assert sorted(map(tuple, retrieval_baselines.run(spark, *small).collect())) == rows
    more = {"baselines": [*retrieval_baselines.DEFAULTS["baselines"][:1], {"id": "flat", "k1": 5, "b": 0.2}]}
    kept = {p: t for p, t in files(small[2]).items() if "baseline=presence" in p}
    assert {r["baseline"] for r in retrieval_baselines.run(spark, *small, more).collect()} == {"bm25", "flat"}
    assert {p: t for p, t in files(small[2]).items() if "baseline=presence" in p} == kept and kept and old


@pytest.mark.parametrize("settings", [{"reference": "none"}, {"baselines": [{"id": "bm25", "k1": 1, "b": 1}] * 2}])
def test_baselines_that_do_not_compare(spark, small, settings):
    with pytest.raises(ValueError, match="reference"):
        retrieval_baselines.run(spark, *small, settings)


def test_no_questions(spark, small, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none"))
    assert retrieval_baselines.run(spark, str(tmp_path / "none"), *small[1:]).count() == 0


def test_a_sweep_equals_single_runs(spark):
    docs = spark.createDataFrame([(i, "alpha " * (i % 4) + "beta " * (i % 3) + f"w{i}") for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha w3"), (2, "beta beta")], "query_id long, query string")
    configs = {"one": DEFAULTS, "two": Settings(bm25_k1=0.4, bm25_b=0.1)}
    got = sorted(map(tuple, retrieval.bm25_sweep(asked, docs, configs).collect()))
    assert got == sorted((name, *r) for name, s in configs.items() for r in map(tuple, retrieval.bm25(asked, docs, s).collect()))


def test_jobs_need_no_corpus_operators():
    code = "import sys, jobs.queries; assert not [m for m in sys.modules if m.startswith(('lodestone.llm', 'corpus_pipeline'))]"
    assert subprocess.run([sys.executable, "-c", code], cwd=HERE, check=False).returncode == 0
