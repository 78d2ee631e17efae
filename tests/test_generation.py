"""Provider loops, benchmark making, reports, request checks."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import requests
from lodestone.operators import answers, benchmark, dataset, generation, reports


def test_rows_are_asked_again_for_what_is_missing(spark):
    rows = spark.createDataFrame([(k,) for k in "abcde"], "k string")
    seen = []

    def ask(todo):
        seen.append(sorted(r["k"] for r in todo.collect()))
        return todo.filter("k <> 'c'").select("k", F.when(F.col("attempt") >= F.when(F.col("k") == "d", 3).otherwise(1), F.upper("k")).alias("said"))

    got = generation.ask_until_valid(rows, "k", ask, lambda a, _: a.filter("said is not null"), attempts=3)
    assert sorted(r["said"] for r in got.collect()) == ["A", "B", "D", "E"] and seen == [list("abcde"), ["c", "d"], ["c", "d"]]


def test_providers_on_lists_are_asked_in_batches(spark):
    ask = generation.in_batches(lambda rows: [{"k": r["k"], "n": len(rows)} for r in rows], "k string, n int", 3)
    got = ask(spark.createDataFrame([(str(i),) for i in range(8)], "k string").coalesce(1)).collect()
    assert sorted(r["n"] for r in got) == [2, 2, 3, 3, 3, 3, 3, 3]
    assert generation._top_level("a int, b array<struct<x:int,y:string>>, c string") == ["a int", " b array<struct<x:int,y:string>>", " c string"]


@pytest.mark.parametrize("n, k", [(6, 2), (2, 5), (7, 3), (100, 7), (9, 9)])
def test_spread_first(spark, n, k):
    got = spark.range(n).select("id", benchmark.spread_first(F.col("id"), F.lit(n), F.lit(k)).alias("x")).collect()
    assert {r["id"] for r in got if r["x"]} == {i * n // k for i in range(k)}


BANK = {c: [f"bank {c} {i}?" for i in range(9)] for c in generation.CATEGORIES}


def cases(spark, n, ask, **more):
    return [tuple(r) for r in generation.triage_cases(spark, n, ask, BANK, **more).collect()]


def test_triage_cases(spark):
    got = cases(spark, 6, lambda c, n, avoid, attempt: [f"{c} {i}?" for i in range(n)] + [f"{c.upper()}  0?", "the same everywhere?"])
    assert len(got) == 18 and len({" ".join(q.lower().split()) for _, q, _ in got}) == 18
    assert [i for i, *_ in got[:2]] == ["in_001", "in_002"] and {i.split("_")[0] for i, *_ in got} == {"in", "amb", "out"} and sum("bank" in q for _, q, _ in got) == 9


def test_bank_fills_and_fails(spark):
    none = lambda *_: []
    assert all("bank" in q for _, q, _ in cases(spark, 3, none))
    for n in (10, 0):
        with pytest.raises(ValueError):
            cases(spark, n, none)


def test_later_attempts_fill_what_repeats(spark):
    asked = []

    def ask(category, n, avoid, attempt):
        asked.append((category, attempt, len(avoid)))
        return [f"{category} {attempt} {i}?" for i in range(2)] + ["shared?"]

    got = cases(spark, 4, ask)
    assert len({q for _, q, _ in got}) == 12 and max(a for _, a, _ in asked) == 2 and all("bank" not in q for _, q, _ in got)
    assert sum(q == "shared?" for _, q, _ in got) == 1


TEXT = "Every gate of the garden has to be shut at night so that no deer come in. "


def made(spark, n=14):
    """Chunks in three documents, of which each third says what the first does."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        own = f"Rule {i % 10} says that the gate number {i % 10} is painted in colour {i % 10} each spring by the keeper. "
        rows.append((f"c{i:02d}", f"d{i % 3}", f"s{i % 2}", "", i, i, "paragraph", 200, own + TEXT * 5 + " ".join(f"x{rnd.randint(0, 999)}" for _ in range(120))))
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, source string, section string, page_start int, page_end int, chunk_type string, n_tokens int, text string")


def facts(chunks):
    span = F.regexp_extract("text", r"^Rule \d+ says that [^.]*\.", 0)
    ask = lambda style: F.struct(F.lit(style).alias("style"), F.concat(F.lit(f"{style}: which gate is meant by "), "chunk_id", F.lit("?")).alias("query"))
    return chunks.select(F.col("chunk_id").alias("fact_id"), F.lit("The gate is painted.").alias("answer"), F.array(span).alias("spans"), F.array(*map(ask, ("natural", "lexical", "semantic"))).alias("questions"))


def test_facts_hold_and_share_no_question(spark):
    chunks = made(spark)
    twice = lambda c: facts(c).withColumn("questions", F.when((F.col("fact_id") < "c02"), F.transform("questions", lambda q: F.struct(q["style"].alias("style"), F.concat(F.lit("The same thing about "), q["style"], F.lit("?")).alias("query")))).otherwise(F.col("questions")))
    got = generation.generate_facts(chunks, lambda c: twice(c).filter("fact_id <> 'c05'"))
    assert sorted(r["fact_id"] for r in got.collect()) == sorted({f"c{i:02d}" for i in range(14)} - {"c01", "c05"})


def test_judgments(spark):
    text = "The keeper paints all the gates of the garden each spring."
    rows = [("none", []), ("none", [text]), ("full", [text[:30]]), ("full", ["short"]), ("partial", [text]), ("full", []), ("perhaps", [text]), ("full", None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, level string, spans array<string>").select("i", benchmark.valid_judgment(F.col("level"), F.col("spans"), F.lit(text)).alias("x"))
    assert [r["x"] for r in got.orderBy("i").collect()] == [True, False, True, False, True, False, False, False]


def test_audit_asks_the_judge_for_the_rest(spark):
    pairs = spark.createDataFrame([("f", "a", ["the gate is shut at night"], "Yes: The  gate is SHUT at night."), ("f", "b", ["the gate is shut at night"], "Gates are closed when the sun is down."), ("f", "c", ["the gate is shut at night"], "Nothing."), ("f", "d", ["the gate is shut at night"], "Left out.")], "fact_id string, chunk_id string, spans array<string>, text string")
    asked = []

    def judge(open_):
        asked.extend(r["chunk_id"] for r in open_.collect())
        return open_.filter("chunk_id <> 'd'").select("fact_id", "chunk_id", F.when(F.col("chunk_id") == "b", "partial").otherwise("full").alias("support_level"), F.array(F.col("text")).alias("evidence_spans"))

    got = {r["chunk_id"]: (r["support_level"], r["match_kind"]) for r in benchmark.audit(pairs, judge).collect()}
    assert got == {"a": ("full", "exact_overlap"), "b": ("partial", "semantic_equivalent")} and sorted(set(asked)) == ["b", "c", "d"]


def test_a_whole_benchmark(spark):
    chunks = made(spark)
    none = lambda open_: open_.select("fact_id", "chunk_id", F.lit("none").alias("support_level"), F.array().cast("array<string>").alias("evidence_spans"))
    cases_, told = dataset.generate(chunks, facts, none, n_single=5, n_multi=7, n_candidates=14)
    rows = cases_.orderBy("id").collect()
    assert told["case_count"] == 12 == len(rows) and told["questions_by_gold_multiplicity"] == {"single_gold": 5, "multi_gold": 7} and len({r["group_id"] for r in rows}) == 5
    for r in rows:
        i = int(r["primary_gold_chunk_id"][1:])
        same = {f"c{j:02d}" for j in range(14) if j % 10 == i % 10}
        assert r["acceptable_gold_chunk_ids"][0] == r["primary_gold_chunk_id"] and set(r["acceptable_gold_chunk_ids"]) == same and r["partial_support_chunk_ids"] == [] and r["gold"]["doc_id"] == f"d{i % 3}"
        assert r["duplication_scope"] == ("unique" if len(same) == 1 else "cross_document")
    assert "By paraphrase type" in reports.dataset_report(told, cases_)
    with pytest.raises(ValueError):
        dataset.generate(chunks, facts, none, n_single=5, n_multi=40, n_candidates=14)


def objects_slowly(text):
    """The first object with matched braces, strings aside; None without one."""
    text = re.sub(r"<think>.*?</think>", "", text, flags=re.S | re.I).strip()
    if fence := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        text = fence[1].strip()
    begin = text.find("{")
    for end in range(begin + 1, len(text) + 1) if begin >= 0 else ():
        try:
            return json.loads(text[begin:end])
        except ValueError:
            continue
    return None


def test_structured_output_equals_a_slow_reader(spark):
    rnd = random.Random(11)
    pieces = ['{"a": 1}', '{"a": {"b": "}"}}', '{"a": "\\"{"}', "<think>{x}</think>", "```json\n", "```", "{", "}", "prose ", '{"b": 2}', '{"a": true}', '"', "\n", '{"a": 1, "c": 3}']
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 5))) for _ in range(300)] + [None, ""]
    bare = lambda t: re.sub(r"<think>.*?</think>", "", t, flags=re.S).strip().removeprefix("```json").removeprefix("```").strip()
    texts = [t for t in texts if t is None or not bare(t).startswith('"')]  # a string is read whole, as one that is no object
    schema = {"type": "object", "properties": {"a": {"type": "integer"}}}
    got = answers.structured(spark.createDataFrame(list(enumerate(texts)), "i int, reply string").repartition(3), schema)
    for r in got.collect():
        want = objects_slowly(r["reply"] or "")
        if want is None:
            assert (r["value"], r["error"], r["place"]) == (None, "no JSON object", None), r
        elif set(want) != {"a"}:
            assert r["value"] is None and r["place"] == "answer" and ("missing" in r["error"] or "unknown" in r["error"]), r
        elif isinstance(want["a"], bool) or not isinstance(want["a"], int):
            assert (r["error"], r["place"]) == ("is no integer", "answer.a"), r
        else:
            assert json.loads(r["value"]) == want and r["error"] is None, r


def test_only_rows_with_errors_are_asked_once_more(spark):
    asked = []

    def ask(rows):
        asked.append({r["k"]: r["error"] if "error" in rows.columns else None for r in rows.collect()})
        told = {1: '{"a": 1}', 2: '{"a": 2}' if len(asked) > 1 else '{"a": "x"}', 3: "nothing"}
        pairs = [(k, v) for k, v in told.items() if k in asked[-1]] + ([(1, "twice")] if 1 in asked[-1] else [])
        return rows.sparkSession.createDataFrame(pairs, "k int, reply string")

    got = answers.ask_structured(spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "k int"), "k", ask, {"type": "object", "properties": {"a": {"type": "integer"}}})
    assert sorted((r["k"], r["value"], r["error"], r["attempts"]) for r in got.collect()) == [(1, '{"a": 1}', None, 1), (2, '{"a": 2}', None, 2), (3, None, "no JSON object", 2), (4, None, "no reply", 2)]
    assert asked == [dict.fromkeys((1, 2, 3, 4)), {2: "is no integer", 3: "no JSON object", 4: "no reply"}]


def test_schema_validation():
    schema = {"type": "object", "required": ["level"], "properties": {"level": {"type": "string", "enum": ["none", "full"]}, "spans": {"type": "array", "items": {"type": "string"}}}}
    assert answers.validated({"level": "full", "spans": ["a"]}, schema) == {"level": "full", "spans": ["a"]}
    for bad in ({}, {"level": "half"}, {"level": "full", "spans": [1]}, {"level": "full", "more": 1}, [], {"level": True}):
        with pytest.raises(ValueError):
            answers.validated(bad, schema)


def test_markdown(spark):
    rows = spark.createDataFrame([("a|b", 0.5, None)], "k string, v double, n int")
    assert reports.markdown_table(rows, show={"v": reports.percent}) == "| k | v | n |\n|---|---|---|\n| a\\|b | 50.00% | — |"


def test_reports_have_a_table_for_each_dimension(spark):
    groups = spark.createDataFrame([("all", "all", 2, 0.5), ("by_source", "a", 1, 1.0), ("by_source", "b", 1, 0.0)], "dimension string, value string, n int, mrr double")
    weakest = spark.createDataFrame([("single", "c1", 0.0, 1), ("multi", "c2", 0.5, 1)], "kind string, case_id string, mrr double, place int")
    text = reports.retrieval_report(groups, weakest, {"k": 10, "device": "cpu"})
    assert text.index("- device: `cpu`") < text.index("## Overall") < text.index("## By by source") < text.index("## Weakest cases: multi") < text.index("## Weakest cases: single")


def test_requests(spark):
    rows = spark.createDataFrame([("{}", " "), ("{}", "x" * 4001), ("y" * 70000, "q"), ("{}", "q")], "body string, question string")
    assert [r["s"] for r in rows.select(requests.verdict(F.col("body"), F.col("question")).alias("s")).collect()] == [400, 400, 413, 200]
    one = spark.range(1).select(requests.logged(F.lit("abcdef"), False).alias("a"), requests.logged(F.lit("abcdef"), True, 3).alias("b"), requests.event("x", n=F.lit(3), q=F.lit("a b")).alias("c")).first()
    assert tuple(one) == ("<6 chars>", "abc...<truncated 3 chars>", 'x n=3 q="a b"')
    seen = spark.createDataFrame([(1, 1, "c", "s", "x", 1, 2, 0.5, False, "secret")], "query_id int, position int, chunk_id string, source string, section string, page_start int, page_end int, rerank_score double, is_neighbor boolean, text string")
    told = requests.evidence_summary(seen).first()["evidence"]
    assert "secret" not in told and '"pages":"pp.1-2"' in told
