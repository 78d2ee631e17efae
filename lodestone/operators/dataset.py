"""A retrieval benchmark made of chunks, end to end: sample, facts, candidates, audit, groups, cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import benchmark, generation
from lodestone.operators.common import ranked
from lodestone.sources.staging import staged

STRATA = ["source", "chunk_type"]
KINDS = ("single_gold", "multi_gold")


def gold_record(spans: Column, level: str, kind: Column) -> Column:
    """A gold chunk as a case holds it."""
    fields = [F.col(c) for c in ("chunk_id", "doc_id", "source", "section", "page_start", "page_end", "chunk_type")]
    return F.struct(*fields, F.lit(level).alias("support_level"), kind.alias("match_kind"), spans.alias("evidence_spans"))


def chunks_fingerprint(chunks: DataFrame) -> str:
    """A hash of all chunks (chunk_id, text) in any order, which rows that repeat change too: of their number and the sum of their hashes."""
    own = F.conv(F.substring(F.sha2(F.to_json(F.struct("chunk_id", "text")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return chunks.agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), F.sum(own).cast("string")), 256).alias("x")).first()["x"]


def generate(chunks: DataFrame, ask: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], n_single: int = 50, n_multi: int = 50, n_candidates: int = 100, seed: int = 43, min_tokens: int = 100, attempts: int = 3, semantic: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, dict]:
    """(cases, metadata) from chunks (chunk_id, doc_id, source, section, page_start, page_end, chunk_type, n_tokens, text).

    ask: from chunks to facts; judge: from pairs to judgments; semantic: from facts to further candidate pairs (fact_id, chunk_id). ValueError where chunks or groups are too few.
    """
    counts = {"single_gold": benchmark.question_counts(n_single), "multi_gold": benchmark.question_counts(n_multi)}
    eligible = benchmark.eligible(chunks, min_tokens)
    picked = staged(benchmark.round_robin(eligible, STRATA, "chunk_id", n_candidates, seed))
    if n_candidates < 1 or picked.count() < n_candidates:
        raise ValueError(f"fewer than {n_candidates} eligible chunks")
    made = staged(generation.generate_facts(picked.drop("turn"), ask, attempts).select("fact_id", "answer", "spans", "questions"))
    tokens = T.token_set(F.concat_ws(" ", "answer", F.array_join("spans", " ")))
    facts = made.withColumn("tokens", tokens)
    routes = {"exact_span": benchmark.exact_span(facts, chunks), "lexical": benchmark.lexical(facts, chunks)}
    if semantic is not None:
        routes["semantic"] = semantic(made)
    pairs = benchmark.candidate_reasons(**routes).join(made.select("fact_id", "answer", "spans"), "fact_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    audit = staged(benchmark.audit(pairs, judge))
    records = chunks.select("chunk_id", "doc_id", "source", "section", "page_start", "page_end", "chunk_type")
    named = audit.join(records, "chunk_id")
    gold = named.groupBy("fact_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("support_level") == "full", gold_record(F.col("evidence_spans"), "full", F.col("match_kind"))))).alias("full"),
        F.array_sort(F.collect_list(F.when(F.col("support_level") == "partial", gold_record(F.col("evidence_spans"), "partial", F.col("match_kind"))))).alias("partial"),
    )
    own = made.join(chunks.withColumnRenamed("chunk_id", "fact_id"), "fact_id").withColumn("chunk_id", F.col("fact_id"))
    primary = own.withColumn("primary", gold_record(F.col("spans"), "full", F.lit("primary"))).withColumn("content_sha256", F.sha2("text", 256))
    whole = primary.join(gold, "fact_id", "left")
    kind = whole.select("primary").schema["primary"].dataType.simpleString()
    empty = F.array().cast(f"array<{kind}>")
    whole = whole.withColumn("gold_chunks", F.concat(F.array("primary"), F.coalesce(F.col("full").cast(f"array<{kind}>"), empty))).withColumn("partial_support_chunks", F.coalesce(F.col("partial").cast(f"array<{kind}>"), empty))
    scopes = benchmark.duplication_scope(whole.select("fact_id", F.explode("gold_chunks").alias("g")).select("fact_id", F.col("g.doc_id").alias("doc_id"))).select("fact_id", "scope")
    groups = staged(whole.withColumn("multiplicity", F.when(F.size("gold_chunks") > 1, "multi_gold").otherwise("single_gold")).join(scopes, "fact_id"))
    chosen = None
    for i, m in enumerate(KINDS):
        want = len(counts[m])
        some = staged(benchmark.round_robin(groups.filter(F.col("multiplicity") == m), STRATA, "fact_id", want, seed + i))
        if some.count() < want:
            raise ValueError(f"fewer than {want} groups of {m}")
        at = ranked(some, [], ["turn", *STRATA, "fact_id"], "_at").withColumn("n_questions", F.element_at(F.array(*map(F.lit, counts[m])), F.col("_at")))  # some dozen groups
        chosen = at if chosen is None else chosen.unionByName(at)
    chosen = chosen.withColumn("group_key", F.format_string("%05d", "_at"))
    cases = benchmark.assemble_cases(chosen.select("multiplicity", "group_key", "n_questions", "questions"))
    facts_of = chosen.select("multiplicity", "group_key", F.col("scope").alias("duplication_scope"), F.col("answer").alias("reference_answer"), F.col("fact_id").alias("primary_gold_chunk_id"), "gold_chunks", "partial_support_chunks", F.struct("doc_id", "source", "section", "page_start", "page_end", "chunk_type", "content_sha256", F.col("spans").alias("evidence_spans")).alias("gold"))
    ids = {"acceptable_gold_chunk_ids": "gold_chunks", "partial_support_chunk_ids": "partial_support_chunks"}
    out = staged(cases.join(facts_of, ["multiplicity", "group_key"]).withColumns({k: F.transform(v, lambda g: g["chunk_id"]) for k, v in ids.items()}).drop("group_key").withColumnRenamed("case_id", "id").withColumnRenamed("multiplicity", "gold_multiplicity").withColumn("type", F.lit("retrieval_grounded")))
    histogram = lambda c: {r[0]: r["count"] for r in out.groupBy(c).count().collect()}  # noqa: E731  of some hundred cases
    fingerprint = chunks_fingerprint(chunks)
    return out, {"schema_version": "2.0", "case_count": out.count(), "group_count": sum(map(len, counts.values())), "candidate_chunk_count": made.count(), "seed": seed, "corpus_fingerprint": fingerprint, "questions_by_gold_multiplicity": histogram("gold_multiplicity"), "questions_by_duplication_scope": histogram("duplication_scope")}
