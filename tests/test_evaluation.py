"""Metrics, reports, comparisons, benchmark making, files, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import benchmark, compare, evaluation
from lodestone.sources import files
from lodestone.streaming import latency as stream


def scores(spark, ranked, grades, ks=(1, 2)):
    cases = spark.createDataFrame([("c",)], "case_id string")
    hits = spark.createDataFrame([("c", x, i) for i, x in enumerate(ranked, 1)], "case_id string, chunk_id string, rank int")
    qrels = spark.createDataFrame([("c", k, g) for k, g in grades.items()], "case_id string, chunk_id string, grade int")
    return evaluation.score_rankings(cases, hits, qrels, ks).first()


def test_ranking_metrics(spark):
    got = scores(spark, ["noise", "a", "noise2"], {"a": 2, "b": 2})
    assert (got["hit_2"], got["recall_2"], got["mrr"]) == (1.0, 0.5, 0.5)
    assert scores(spark, ["b", "a"], {"a": 2, "b": 2})["ndcg_2"] == 1.0


def test_partial_support(spark):
    got = scores(spark, ["p", "a"], {"a": 2, "b": 2, "p": 1})
    assert (got["hit_1"], got["recall_1"], got["mrr"]) == (0.0, 0.0, 0.5) and 0 < got["ndcg_1"] < 1


def test_no_gold(spark):
    got = scores(spark, ["a"], {"z": 1})
    assert (got["hit_1"], got["recall_1"], got["mrr"], got["ndcg_1"]) == (0.0, 0.0, 0.0, 0.0)


def test_citations(spark):
    cases = spark.createDataFrame([("c", "p", ["p", "alt"]), ("d", "p", ["p"])], "case_id string, primary_id string, gold array<string>")
    got = {r["case_id"]: r for r in evaluation.score_citations(cases, spark.createDataFrame([("c", "alt"), ("c", "noise")], "case_id string, chunk_id string")).collect()}
    assert (got["c"]["citation_precision"], got["c"]["citation_hit"], got["c"]["primary_citation_hit"]) == (0.5, 1, 0)
    assert got["d"]["citation_precision"] is None


def test_latency(spark):
    got = evaluation.latency(spark.createDataFrame([(i, float(v), "x") for i, v in enumerate((4, 1, 2, 3))], "at int, v double, k string"), ["k"], "v", "at").first()
    assert (got["p95_s"], got["max_s"], got["median_s"], got["mean_excluding_first_s"]) == (4.0, 4.0, 2.5, 2.0)
    alone = evaluation.latency(spark.createDataFrame([(0, 7.0, "x")], "at int, v double, k string"), ["k"], "v", "at").first()
    assert alone["mean_excluding_first_s"] == 7.0


def test_weakest_has_nulls_first(spark):
    rows = spark.createDataFrame([("g", "a", 1.0), ("g", "b", None), ("g", "c", 0.5)], "k string, case_id string, m double")
    assert [r["case_id"] for r in evaluation.weakest(rows, "k", ["m"], 2).orderBy("place").collect()] == ["b", "c"]


@pytest.mark.parametrize("total, want", [(50, [3] * 16 + [2]), (2, [2]), (4, [2, 2]), (9, [3, 3, 3])])
def test_question_counts(total, want):
    assert benchmark.question_counts(total) == want


def test_scopes(spark):
    gold = [("u", "d1"), ("s", "d1"), ("s", "d1"), ("x", "d1"), ("x", "d2"), ("m", "d1"), ("m", "d1"), ("m", "d2")]
    got = {r["fact_id"]: r["scope"] for r in benchmark.duplication_scope(spark.createDataFrame(gold, "fact_id string, doc_id string")).collect()}
    assert got == {"u": "unique", "s": "same_document", "x": "cross_document", "m": "mixed"}


def test_round_robin_is_even_and_whole(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(50)], "id int, k string")
    got = benchmark.round_robin(rows, ["k"], "id", 8).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 4, "b": 4}
    assert benchmark.round_robin(rows, ["k"], "id", 99).count() == 50


def test_items(spark):
    text = "Multi-factor authentication is required for all remote access to systems."
    spans, queries, styles = [text[:40]], ["Is it needed at home?", "Who needs factors?", "What is required?"], ["semantic", "lexical", "natural"]
    def ok(**change):
        row = {"text": text, "answer": "It is required.", "spans": spans, "queries": queries, "styles": styles} | change
        c = {k: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)) for k, v in row.items()}
        return spark.range(1).select(benchmark.valid_item(c["text"], c["answer"], c["spans"], c["queries"], c["styles"], ("according to the passage",)).alias("x")).first()["x"]
    assert ok()
    assert not ok(spans=["short"]) and not ok(spans=["y" * 30]) and not ok(answer="no") and not ok(styles=["lexical", "lexical", "natural"]) and not ok(styles=["lexical", "formal", "natural"]) and not ok(queries=queries[:2] + queries[:1])
    assert not ok(queries=[*queries[:2], "According to the passage, what?"]) and not ok(queries=[*queries[:2], "No question mark here"])


def test_cases_of_two_have_no_lexical_question(spark):
    asked = [("natural", "q1?"), ("lexical", "q2?"), ("formal", "q3?")]
    rows = spark.createDataFrame([("g1", "single", 2, asked), ("g2", "single", 3, asked)], "group_key string, multiplicity string, n_questions int, questions array<struct<style:string,query:string>>")
    got = benchmark.assemble_cases(rows).orderBy("case_id").collect()
    assert [r["case_id"] for r in got] == [f"ret_{i:03d}" for i in range(1, 6)] and [r["paraphrase_type"] for r in got[:2]] == ["natural", "formal"]


def test_candidates(spark):
    facts = spark.createDataFrame([("f", ["alpha beta gamma delta", "say al"], ["alpha", "beta", "gamma", "delta"])], "fact_id string, spans array<string>, tokens array<string>")
    chunks = spark.createDataFrame([("f", "Alpha beta  gamma delta"), ("x", "say ALPHA beta gamma\ndelta."), ("y", "gamma beta alpha"), ("z", "alpha beta")], "chunk_id string, text string")
    assert [r["chunk_id"] for r in benchmark.exact_span(facts, chunks).collect()] == ["x"]
    assert sorted(r["chunk_id"] for r in benchmark.lexical(facts, chunks).collect()) == ["y"] or sorted(r["chunk_id"] for r in benchmark.lexical(facts, chunks).collect()) == ["x", "y"]


def test_best_run_and_deltas(spark):
    manifest = spark.createDataFrame([("m", None), ("n", "query")], "model string, prompt string")
    runs = spark.createDataFrame([("r1", "m", "", 100, "2024", 0.5, "v"), ("r2", "m", None, 100, "2025", 0.6, "v"), ("r3", "m", "", 9, "2026", 0.9, "v")], "run_id string, model string, prompt string, case_count int, created_at string, score double, version string")
    best = compare.best_runs(manifest, runs, ["model"])
    rows = {r["model"]: r for r in best.collect()}
    assert rows["m"]["run_id"] == "r2" and rows["n"]["run_id"] is None
    checked = compare.same_benchmark(best, best.filter("model = 'm'"), ["version"])
    assert {r["model"]: r["comparable"] for r in checked.collect()} == {"m": True, "n": False}
    assert {r["model"]: r["delta"] for r in compare.deltas(checked, best.filter("model = 'm'"), "score").collect()} == {"m": "+0.00 pp", "n": "—"}


def test_chunk_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"chunk_id": "d-00003", "doc_id": "d", "text": "é"}) + "\n\n")
    row = files.read_chunks(spark, str(tmp_path / "c.jsonl")).first()
    assert (row["chunk_index"], row["chunk_type"], row["table_headers"]) == (3, "paragraph", [])
    files.write_chunks(files.read_chunks(spark, str(tmp_path / "c.jsonl")), str(tmp_path / "out"))
    assert files.read_chunks(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "d"}\n')
    with pytest.raises(ValueError):
        files.read_chunks(spark, str(tmp_path / "bad.jsonl"))


def test_case_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"dataset_schema_version": "2.0", "cases": [{"id": "1", "query": "q"}, {"id": "2", "query": "r"}]}))
    assert files.read_cases(spark, str(tmp_path / "a.json"), ids=["2"]).first()["query"] == "r"
    with pytest.raises(ValueError):
        files.read_cases(spark, str(tmp_path / "a.json"), version="1.0")


def test_corpus_ids_are_of_names(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "NIST.CSWP.29.PDF").write_bytes(b"%PDF")
    (tmp_path / "n.txt").write_text("no")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert [r["source"] for r in files.corpus(spark, str(tmp_path)).collect()] == ["a.pdf", "NIST.CSWP.29.PDF"]
    with pytest.raises(ValueError):
        files.corpus(spark, str(tmp_path), ".doc")


def test_report_sections():
    once = files.upsert_section("Head", "<a>", "</a>", "one")
    assert files.upsert_section(once, "<a>", "</a>", "two") == once.replace("one", "two")


def test_resume(spark):
    cases, old = spark.createDataFrame([("1",), ("2",)], "case_id string"), spark.createDataFrame([("1", 5)], "case_id string, x int")
    todo, reused = files.resume(cases, old, {"k": 1}, {"k": 1})
    assert [r["case_id"] for r in todo.collect()] == ["2"] and reused.count() == 1
    assert files.resume(cases, old, {"k": 1}, {"k": 2})[0].count() == 2


def test_appended_results(spark, tmp_path):
    path = str(tmp_path / "r")
    files.append_results(spark.createDataFrame([("1", 1), ("2", 1)], "case_id string, x int"), path)
    assert files.append_results(spark.createDataFrame([("2", 5)], "case_id string, x int"), path) == 2
    want = [("1", 1), ("2", 5)]
    held = lambda: sorted((r["case_id"], r["x"]) for r in files.read_results(spark, path).collect())
    assert held() == want and files.read_results(spark, str(tmp_path / "none")) is None
    # a run that ends between its rows and its entry counts nowhere; done again, it counts once
    real, files.read_run = files.read_run, lambda *a: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            files.append_results(spark.createDataFrame([("1", 7), ("3", 7)], "case_id string, x int"), path)
    finally:
        files.read_run = real
    assert held() == want
    new = spark.createDataFrame([("1", 8), ("1", 9), ("3", 7)], "case_id string, x int")
    assert files.append_results(new, path) == 3 and held() == [("1", 9), ("2", 5), ("3", 7)]
    assert files.append_results(new, path, 3) == 3 and held() == [("1", 9), ("2", 5), ("3", 7)]


def test_payloads_and_passages(spark):
    rows = spark.createDataFrame([("d-00004", "d", "s", "text", "paragraph", "", ["A"]), ("d-00005", "d", "s", "row", "table", "Cap", ["A"])], "chunk_id string, doc_id string, source string, text string, chunk_type string, table_caption string, table_headers array<string>")
    got = {r["chunk_type"]: r for r in files.payload(rows).collect()}
    assert got["paragraph"]["table_headers"] is None and got["table"]["table_caption"] == "Cap"
    one = files.as_evidence(files.payload(rows).filter("chunk_type = 'paragraph'"), 2).first()
    assert (one["chunk_index"], one["table_headers"], one["page_start"], one["is_neighbor"], one["round"], one["rerank_score"], one["seed_chunk_id"]) == (4, [], 0, False, 2, 0.0, "")


def test_smoke_rows(spark):
    cases = spark.createDataFrame([("1", "q", "in_scope", ["a.pdf"], ["Gate", "deer"], None), ("2", "r", "out_of_scope", [], [], True), ("3", "s", "in_scope", ["a.pdf"], [], False)], "id string, query string, expected_category string, expected_sources array<string>, must_include array<string>, expect_insufficient boolean")
    states = spark.createDataFrame([("1", "in_scope", "answered", 1, "the gate", "high", [("a.pdf",), ("b.pdf",)], []), ("2", "in_scope", "answered_partial", 3, "x", "low", [], [9])], "query_id string, category string, status string, rounds int, response string, confidence string, citations array<struct<source:string>>, dropped array<int>")
    got = {r["id"]: r for r in evaluation.smoke_rows(cases, states).collect()}
    assert (got["1"]["triage_correct"], got["1"]["source_hit"], got["1"]["source_precision"], got["1"]["keyword_recall"], got["1"]["abstained"], got["1"]["cited_sources"]) == (1, 1.0, 0.5, 0.5, None, "a.pdf|b.pdf")
    assert (got["2"]["triage_correct"], got["2"]["abstained"], got["2"]["citation_integrity"], got["2"]["source_hit"]) == (0, 1, 0, None)
    assert (got["3"]["status"], got["3"]["triage_correct"], got["3"]["source_precision"]) == ("error", 0, 0.0)
    assert evaluation.smoke_summary(evaluation.smoke_rows(cases, states)).first()["n"] == 3


def test_latency_without_the_first(spark):
    rows = [("a", 2, 5.0), ("a", 1, 100.0), ("a", 3, 7.0), ("b", 1, None), ("b", 2, 4.0), ("c", 1, 9.0), ("d", 1, None)]
    got = {r["k"]: r for r in evaluation.latency(spark.createDataFrame(rows, "k string, at int, v double"), ["k"], "v", "at").collect()}
    assert [got[k]["mean_excluding_first_s"] for k in "abcd"] == [6.0, 4.0, 9.0, None]


def test_latency_change(spark):
    from lodestone.functions import text as T

    got = spark.range(1).select(T.change(F.lit(3.0), F.lit(4.0)).alias("a"), T.change(F.lit(3.0), F.lit(0.0)).alias("b"), T.change(F.lit(None).cast("double"), F.lit(1.0)).alias("c")).first()
    assert tuple(got) == ("25.00%", "—", "—")


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, "view", 2.0), ("2024-01-01 00:20:00", 1, "view", 4.0), ("2024-01-01 03:00:00", 2, "buy", 1.0)], "ts string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.windowed(live).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["event_type"], r["n"], r["max_value"]) for r in spark.table("w").collect()} == {("view", 2, 4.0), ("buy", 1, 1.0)}
    assert stream.sessions(rows).count() == 2


def test_markdown_files(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0, "# A", 1), ("d", 1, "b", 1), ("d", 2, "c", 2)], "doc_id string, seq int, text string, page_start int")
    files.write_markdown(rows, str(tmp_path / "md"))
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "md" / "doc_id=d")).collect()) == "# A\n\nb\n\n<!-- page break -->\n\nc"


def test_injected_models(spark):
    from lodestone.operators import models

    rows = spark.createDataFrame([("ab", "q"), (None, "q")], "text string, query string")
    got = models.score(models.encode(rows, lambda: lambda ts: [[len(t), 1] for t in ts], batch=1), lambda: lambda qs, ts: [len(q) + len(t) for q, t in zip(qs, ts, strict=True)]).collect()
    assert [(r["vector"], r["rerank_score"]) for r in got] == [([2.0, 1.0], 3.0), ([0.0, 1.0], 1.0)]
