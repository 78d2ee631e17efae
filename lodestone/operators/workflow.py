"""The bounded loop from question to cited answer, over all open questions at once: triage, retrieve, verify, answer.

Decisions come from injected providers, functions from DataFrame to DataFrame; rule-based stand-ins ship with it and are no model. Each round is one batch plan; finished questions are set aside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions import text as T
from lodestone.operators import answers, retrieval
from lodestone.sources.staging import staged

CLARIFY = "Could you say more precisely what you are asking about?"
REJECT = "This question is outside what the indexed documents cover."
NOTHING = "No passage was found."
UNSUPPORTED = "No passage was named as support."
INSUFFICIENT = "The indexed documents hold too little to answer this reliably."
EXHAUSTED = "After %d rounds of retrieval some of the question is still open; this answer rests on the passages found."
STATE = "query_id, status, rounds, n_evidence, tried, response, confidence, caveats, citations, dropped, trace"
_TEXTS, _INTS = "array<string>", "array<int>"
CITATION = "struct<marker:int,chunk_id:string,source:string,section:string,pages:string,quote:string>"


def triage_rules(decisions: DataFrame) -> DataFrame:
    """decisions (query_id, query, category, search_queries, clarifying_question, rejection_reason) with their defaults filled in and the route.

    Searches are stripped, empty ones go, three stay; an in-scope question without any searches by itself.
    """
    plan = F.slice(F.filter(F.transform(F.coalesce("search_queries", F.array().cast("array<string>")), T.strip), lambda q: q != ""), 1, 3)
    in_scope = F.col("category") == "in_scope"
    return decisions.select(
        "query_id", "query", "category", F.when(in_scope & (F.size(plan) == 0), F.array("query")).otherwise(plan).alias("search_queries"),
        F.when(F.col("category") == "ambiguous", F.coalesce(F.nullif(T.strip("clarifying_question"), F.lit("")), F.lit(CLARIFY))).alias("clarifying_question"),
        F.when(F.col("category") == "out_of_scope", F.coalesce(F.nullif(T.strip("rejection_reason"), F.lit("")), F.lit(REJECT))).alias("rejection_reason"),
        F.when(F.col("category") == "out_of_scope", "reject").when(F.col("category") == "ambiguous", "clarify").otherwise("retrieve").alias("route"),
    )


def verdict_rules(verdicts: DataFrame) -> DataFrame:
    """verdicts (query_id, n, sufficient, supporting ARRAY<INT>, rewrites[, missing]) with numbers out of 1..n gone; no evidence or no support is not sufficient, and without evidence
    nothing is searched again. Nulls are empty, and not sufficient."""
    good = F.filter(F.coalesce("supporting", F.array().cast(_INTS)), lambda i: i.between(1, F.col("n")))
    told = F.coalesce("missing", F.lit("")) if "missing" in verdicts.columns else F.lit("")
    missing = F.when(F.col("n") == 0, NOTHING).when((told == "") & F.col("sufficient") & (F.size(good) == 0), UNSUPPORTED).otherwise(told)
    rewrites = F.when(F.col("n") > 0, F.coalesce("rewrites", F.array().cast(_TEXTS))).otherwise(F.array().cast(_TEXTS))
    return verdicts.select("query_id", "n", good.alias("supporting"), (F.coalesce("sufficient", F.lit(False)) & (F.col("n") > 0) & (F.size(good) > 0)).alias("sufficient"), rewrites.alias("rewrites"), missing.alias("missing"))


def verify_route(sufficient, round_no, rewrites, settings: Settings = DEFAULTS):
    """answer if the evidence is sufficient, the rounds are used up or nothing else is left to search; else retry."""
    return F.when(sufficient | (round_no >= settings.max_rounds) | (F.size(rewrites) == 0), "answer").otherwise("retrieve")


def answer_status(sufficient, n_evidence):
    return F.when(sufficient, "answered").when(n_evidence > 0, "answered_partial").otherwise("insufficient")


def narrow(evidence: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): endorsed passages in the verdict's order, repeats included, or all where a sufficient verdict names none; rejected are those an insufficient one does not endorse."""
    at = verdicts.select("query_id", "sufficient", F.posexplode("supporting").alias("order", "position"))
    kept = evidence.join(at, ["query_id", "position"]).withColumn("position", (F.col("order") + 1).cast("int")).drop("order", "sufficient")
    bare = verdicts.filter(F.col("sufficient") & (F.size("supporting") == 0)).select("query_id")
    kept = kept.unionByName(evidence.join(bare, "query_id", "left_semi"))
    failed = verdicts.filter(~F.col("sufficient")).select("query_id")
    rejected = evidence.join(failed, "query_id", "left_semi").join(at.select("query_id", "position"), ["query_id", "position"], "left_anti").select("query_id", "chunk_id")
    return kept, rejected


@dataclass(frozen=True)
class Providers:
    """What decides and searches.

    triage: questions (query_id, query) to decisions; search: (query_id, list_no, query) to ranked lists (query_id, list_no, doc_id, rank, rerank_score), reranked; verify: (query_id, query, round, n) and evidence to
    verdicts; answer: (query_id, query) and evidence to (query_id, answer, used, confidence, caveats); chunks (chunk_id, doc_id, chunk_index, section, source, page_start, page_end, text): what
    neighbours and citations are looked up in, if given. A question that a provider leaves out counts as not judged, or not answered.
    """

    triage: Callable[[DataFrame], DataFrame]
    search: Callable[[DataFrame], DataFrame]
    verify: Callable[[DataFrame, DataFrame], DataFrame]
    answer: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    chunks: DataFrame | None = None


def lexical_search(chunks: DataFrame, settings: Settings = DEFAULTS, id_col: str = "doc_id") -> Callable[[DataFrame], DataFrame]:
    """The stand-in search: BM25, reranked by token coverage; each query keeps as many hits as are fused."""

    def search(asked: DataFrame) -> DataFrame:
        keyed = asked.withColumn("key", F.concat_ws("/", F.col("query_id").cast("string"), F.col("list_no").cast("string")))
        hits = retrieval.bm25_top(keyed, chunks, settings.top_k_fused, settings, id_col=id_col, query_id="key")
        named = hits.withColumnRenamed("query_id", "key").join(keyed.select("key", "query"), "key").join(chunks.select(F.col(id_col).alias("doc_id"), "text"), "doc_id")
        scored = named.select(F.col("key").alias("query_id"), "doc_id", "rank", retrieval.coverage(F.col("query"), F.col("text")).alias("rerank_score"))
        best = retrieval.rerank(scored, settings, settings.top_k_fused).withColumnRenamed("query_id", "key").join(keyed.select("key", "query_id", "list_no"), "key")
        return best.select("query_id", "list_no", "doc_id", F.col("new_rank").alias("rank"), "rerank_score")

    return search


def coverage_verdict(least: float = 0.5, support: int = 2) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The stand-in verifier: passages of enough coverage support; so many are sufficient; a retry drops the question's first word."""

    def verify(questions: DataFrame, evidence: DataFrame) -> DataFrame:
        good = evidence.filter(F.col("rerank_score") >= least).groupBy("query_id").agg(F.array_sort(F.collect_list("position")).alias("supporting"))
        rows = questions.join(good, "query_id", "left").withColumn("supporting", F.coalesce("supporting", F.array().cast(_INTS)))
        rest = F.regexp_replace("query", r"^\S+\s+", "")
        return rows.select("query_id", "n", (F.size("supporting") >= support).alias("sufficient"), "supporting", F.when(rest != F.col("query"), F.array(rest)).otherwise(F.array().cast(_TEXTS)).alias("rewrites"))

    return verify


def pointing_answer(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """The stand-in answer: it points to every passage."""
    at = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list("position")).alias("used"))
    text = F.concat(F.lit("See "), F.array_join(F.transform("used", lambda m: F.concat(F.lit("["), m.cast("string"), F.lit("]"))), ", "), F.lit("."))
    return questions.join(at, "query_id").select("query_id", text.alias("answer"), "used", F.lit("medium").alias("confidence"), F.lit("").alias("caveats"))


def retrieve(asked: DataFrame, rejected: DataFrame | None, providers: Providers, settings: Settings = DEFAULTS, keep: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """(query_id, chunk_id, rerank_score, is_neighbor, seed_chunk_id, position) of a round: each query's list without rejected passages, fused to seeds, with their neighbours. keep: writes down the lists and the seeds, which
    are read several times."""
    lists = keep(providers.search(asked))
    if rejected is not None:
        lists = retrieval.exclude(lists, rejected.withColumnRenamed("chunk_id", "doc_id"))
    seeds = keep(retrieval.fuse_queries(lists, settings).select("query_id", F.col("doc_id").alias("chunk_id"), "rerank_score", "rank"))
    if providers.chunks is None:
        return seeds.select("query_id", "chunk_id", "rerank_score", F.lit(False).alias("is_neighbor"), F.lit("").alias("seed_chunk_id"), F.col("rank").cast("long").alias("position"))
    placed = seeds.join(providers.chunks.select("chunk_id", "doc_id", "chunk_index", "section"), "chunk_id")
    all_ = retrieval.expand_neighbors(placed, providers.chunks, rejected, settings.neighbor_window, settings.neighbor_max_total, settings.neighbor_same_section)
    return all_.join(seeds.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"), "is_neighbor", "seed_chunk_id", "position")


def write_answers(routed: DataFrame, evidence: DataFrame, providers: Providers) -> DataFrame:
    """The final state of routed questions (query_id, query, sufficient, round, n_evidence, missing, tried, trace): answered from their evidence, where they have any."""
    mine = evidence.join(routed.select("query_id"), "query_id", "left_semi")
    given = (providers.answer or pointing_answer)(routed.filter("n_evidence > 0").select("query_id", "query"), mine)
    both = routed.join(given, "query_id", "left").withColumnRenamed("n_evidence", "n").filter("n > 0")
    prefix = F.when(F.col("sufficient"), "").otherwise(F.format_string(EXHAUSTED, "round"))
    done = answers.finish_answers(both.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), "used", F.coalesce("confidence", F.lit("low")).alias("confidence"), F.coalesce("caveats", F.lit("")).alias("caveats"), prefix.alias("prefix"), F.col("n").cast("int").alias("n")))
    texts = ("source", "section", "page_start", "page_end", "text")
    named = mine.withColumn("chunk_id", F.col("chunk_id").cast("string"))
    if providers.chunks is None:
        named = named.withColumns({c: F.lit(None).cast("int" if c.startswith("page") else "string") for c in texts})
    else:
        named = named.join(providers.chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), *texts), "chunk_id", "left")
    cited = answers.citations(done, named).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "chunk_id", "source", "section", "pages", "quote"))).cast(f"array<{CITATION}>").alias("citations"))
    whole = routed.join(done.select("query_id", "answer", F.col("confidence").alias("_confidence"), F.col("caveats").alias("_caveats"), F.col("dropped").alias("_dropped")), "query_id", "left").join(cited, "query_id", "left")
    failed = F.concat(F.lit(INSUFFICIENT), F.when(F.col("missing") != "", F.concat(F.lit(" Missing: "), "missing")).otherwise(""))
    return whole.select(
        "query_id", answer_status(F.col("sufficient"), F.col("n_evidence")).alias("status"), F.col("round").alias("rounds"), "n_evidence", "tried", F.when(F.col("n_evidence") > 0, F.col("answer")).otherwise(failed).alias("response"),
        F.coalesce("_confidence", F.lit("")).alias("confidence"), F.coalesce("_caveats", F.lit("")).alias("caveats"), F.coalesce("citations", F.array().cast(f"array<{CITATION}>")).alias("citations"), F.coalesce("_dropped", F.array().cast("array<decimal(38,0)>")).alias("dropped"), "trace",
    )


def _ended(decided: DataFrame) -> DataFrame:
    """The final state of questions that triage ends."""
    none = {"rounds": F.lit(0), "n_evidence": F.lit(0).cast("long"), "tried": F.array().cast(_TEXTS), "confidence": F.lit(""), "caveats": F.lit(""), "citations": F.array().cast(f"array<{CITATION}>"), "dropped": F.array().cast("array<decimal(38,0)>")}
    status = F.when(F.col("route") == "reject", "rejected").otherwise("needs_clarification")
    said = F.when(F.col("route") == "reject", F.col("rejection_reason")).otherwise(F.col("clarifying_question"))
    return decided.filter("route <> 'retrieve'").withColumns(none | {"status": status, "response": said, "trace": F.array(F.concat(F.lit("triage: "), "route"))}).select(*STATE.split(", "))


def run(questions: DataFrame, providers: Providers, settings: Settings = DEFAULTS, keep: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """The final state of every question, after at most max_rounds rounds: (query_id, status, rounds, n_evidence, tried, response, confidence, caveats, citations, dropped, trace).

    keep: cuts the lineage after each round. Queries, rejected passages and the trace are only ever added to.
    """
    decided = keep(triage_rules(providers.triage(questions)))
    done = _ended(decided)
    state = decided.filter("route = 'retrieve'").select("query_id", "query", "search_queries", F.array().cast(_TEXTS).alias("tried"), F.array(F.lit("triage: retrieve")).alias("trace"))
    evidence = rejected = None
    for round_no in range(1, settings.max_rounds + 1):
        asked = state.select("query_id", F.posexplode("search_queries").alias("list_no", "query"))
        fresh = retrieve(asked, rejected, providers, settings, keep)
        now = keep(retrieval.merge_evidence(fresh.limit(0) if evidence is None else evidence, fresh, settings.working_set))
        open_ = keep(
            state.join(now.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
            .select("query_id", "query", F.concat("tried", "search_queries").alias("tried"), F.coalesce("n", F.lit(0)).cast("int").alias("n"), F.lit(round_no).alias("round"), F.concat("trace", F.array(F.format_string("retrieve %d: %d passages", F.lit(round_no), F.coalesce("n", F.lit(0))))).alias("trace"))
        )
        told = providers.verify(open_.filter("n > 0").select("query_id", "query", "round", "n"), now).drop("n", "query", "round")
        verdicts = keep(verdict_rules(open_.select("query_id", "n").join(told, "query_id", "left")))
        kept, bad = narrow(now, verdicts)
        evidence, rejected = keep(kept), keep(bad if rejected is None else rejected.unionByName(bad))
        left = evidence.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
        both = open_.drop("n").join(verdicts.drop("n"), "query_id").join(left, "query_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
        both = both.withColumn("route", verify_route(F.col("sufficient"), F.col("round"), F.col("rewrites"), settings))
        routed = keep(both.withColumn("trace", F.concat("trace", F.array(F.format_string("verify %d: %s", "round", "route")))))
        done = done.unionByName(keep(write_answers(routed.filter("route = 'answer'"), evidence, providers)))
        state = routed.filter("route = 'retrieve'").select("query_id", "query", F.col("rewrites").alias("search_queries"), "tried", "trace")
        if not state.limit(1).count():
            break
    return done
