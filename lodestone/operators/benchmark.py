"""Making retrieval benchmarks: eligible chunks, stratified samples, candidates, audits, cases."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.common import in_order, ranked, small, top

#: Parts of section names whose chunks make no questions.
EXCLUDED_SECTIONS = (
    "table of contents", "contents", "acknowledg", "keywords", "references", "how to cite", "change log", "change record", "revision history",
    "reports on computer systems technology", "disclaimer", "incident response recommendations and considerations for cybersecurity risk management",
)
LEAST_SPAN, LEAST_ANSWER, LEAST_QUERY = 25, 12, 12
#: The styles of an item's questions.
STYLES = ("lexical", "semantic", "natural")


def eligible(chunks: DataFrame, min_tokens: int = 100) -> DataFrame:
    section = F.lower(F.coalesce("section", F.lit("")))
    return chunks.filter((F.col("n_tokens") >= min_tokens) & (F.length(T.collapse("text")) >= 300) & ~F.exists(F.array(*map(F.lit, EXCLUDED_SECTIONS)), lambda t: F.contains(section, t)))


def round_robin(rows: DataFrame, strata: list[str], key: str, n: int, seed: int = 43) -> DataFrame:
    """n rows dealt from the strata in turn, each in the order of a hash of seed and key; `turn` is the round, `place` the order of the sample."""
    mixed = lambda *c: F.md5(F.concat(F.lit(f"{seed}|"), *(x.cast("string") for x in c)).cast("binary"))
    turns = top(rows.withColumn("_h", mixed(F.col(key))), strata, ["_h", key], n, "turn").withColumn("_s", mixed(*(F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata)))
    return turns.orderBy("turn", "_s", *strata).limit(n).drop("_h", "_s")


def question_counts(total: int) -> list[int]:
    """Questions of each group, two or three, that sum to the total, in as many groups as threes allow."""
    if total < 2:
        raise ValueError("at least two questions")
    groups = min(math.ceil(total / 3), total // 2)
    counts = [3 if i < total - 2 * groups else 2 for i in range(groups)]
    if sum(counts) != total:
        raise ValueError(f"{total} questions cannot be dealt in twos and threes")
    return counts


#: Characters of spans that are searched for together, which bounds the automaton of a task and what is broadcast.
SPAN_CHARS = 1_000_000


def holding(texts: DataFrame, spans: DataFrame, most: int = SPAN_CHARS) -> DataFrame:
    """Rows of texts (chunk_id, body) and spans (span, ...) where the body has the span: chunk_id and the columns of spans but span.

    Texts are read where they lie, once for each block of spans, by an automaton of all spans of the block: no text is shuffled, and a span of one letter costs what a long one does.
    """
    asked = spans.filter("span <> ''").distinct()
    spark, parts, block, size = texts.sparkSession, [], [], 0
    kind = dict(texts.dtypes)["chunk_id"]

    def searched() -> None:
        sent, numbered = spark.sparkContext.broadcast(list(block)), list(enumerate(block))

        def found(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, span in enumerate(sent.value):
                automaton.add_word(span, i)
            automaton.make_automaton()
            for pdf in it:
                hits = [{i for _, i in automaton.iter(body)} if body else () for body in pdf["body"]]
                yield pd.DataFrame({"chunk_id": np.repeat(pdf["chunk_id"].to_numpy(), [len(h) for h in hits]), "_span": [i for h in hits for i in sorted(h)]})

        pairs = texts.select("chunk_id", "body").mapInPandas(found, f"chunk_id {kind}, _span int")
        names = F.broadcast(spark.createDataFrame(numbered, "_span int, span string"))  # the block
        parts.append(pairs.join(names, "_span").drop("_span"))

    for row in asked.select("span").distinct().toLocalIterator():
        block.append(row["span"])
        size += len(row["span"])
        if size >= most:
            searched()
            block, size = [], 0
    if block:
        searched()
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"chunk_id {kind}, span string")
    return found.join(small(asked), "span").drop("span")


def exact_span(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(fact_id, chunk_id) where the chunk's normalised text has a span of the fact; itself aside. facts: fact_id, spans."""
    asked = facts.select("fact_id", F.explode(F.transform("spans", T.normalise)).alias("span"))
    return holding(chunks.select("chunk_id", T.normalise("text").alias("body")), asked).select("fact_id", "chunk_id").filter("fact_id <> chunk_id").distinct()


def lexical_pairs(facts: DataFrame, chunks: DataFrame, share: float = 0.72) -> DataFrame:
    """(fact_id, n, chunk_id) of the pairs that lexical() counts: a chunk with enough of a fact's n tokens has one of its n - least + 1 rarest, where least is share * n, rounded up, and is at least that large."""
    asked = facts.select("fact_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    own = chunks.select("chunk_id", T.token_set("text").alias("set")).select("chunk_id", F.size("set").alias("size"), F.explode("set").alias("token"))
    mine = own.join(small(asked.select("token").distinct()), "token", "left_semi")
    often = mine.groupBy("token").agg(F.count("*").alias("df"))
    least = F.ceil(F.col("n") * share - 1e-9).cast("int")
    rare = ranked(asked.join(often, "token"), ["fact_id"], ["df", "token"], "_at")  # tokens that no chunk has are the rarest of all, and leave fewer places
    held = rare.groupBy("fact_id").agg(F.count("*").alias("_held"))
    first = rare.join(held, "fact_id").filter(F.col("_at") <= F.col("_held") - least + 1).select("fact_id", "n", least.alias("least"), "token")
    return mine.join(small(first), "token").filter("size >= least and fact_id <> chunk_id").select("fact_id", "n", "chunk_id").distinct()


def lexical(facts: DataFrame, chunks: DataFrame, share: float = 0.72) -> DataFrame:
    """(fact_id, chunk_id) where the chunk has that share of the fact's tokens: candidates share a rare token, and their sets are compared. facts: fact_id, tokens ARRAY."""
    pairs = lexical_pairs(facts, chunks, share)
    sets = chunks.select("chunk_id", T.token_set("text").alias("set")).join(pairs, "chunk_id")
    common = F.size(F.array_intersect("tokens", "set"))
    return sets.join(small(facts.select("fact_id", F.array_distinct("tokens").alias("tokens"))), "fact_id").filter(common / F.col("n") >= share).select("fact_id", "chunk_id")


def semantic(scored: DataFrame, n: int) -> DataFrame:
    """The n best of scored (fact_id, chunk_id, score) for each fact; itself aside, also where that leaves fewer."""
    return top(scored.filter("fact_id <> chunk_id"), ["fact_id"], [F.col("score").desc(), "chunk_id"], n).select("fact_id", "chunk_id")


def candidate_reasons(**routes: DataFrame) -> DataFrame:
    """(fact_id, chunk_id, reasons): the sorted names of the routes that found each pair."""
    found = None
    for name, df in routes.items():
        one = df.select("fact_id", "chunk_id", F.lit(name).alias("reason"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("fact_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def audit_exact(pairs: DataFrame) -> DataFrame:
    """pairs (fact_id, chunk_id, spans, text): full support by exact overlap where every span is in the text; the others need a judge."""
    body = T.normalise("text")
    every = (F.size("spans") > 0) & F.forall("spans", lambda s: F.contains(body, T.normalise(s)))
    return pairs.select("fact_id", "chunk_id", F.when(every, "full").otherwise("unjudged").alias("support_level"), F.when(every, "exact_overlap").otherwise("judge").alias("match_kind"))


def valid_judgment(level: Column, spans: Column, text: Column) -> Column:
    """Whether a judgment holds: no support without spans, full or partial support with spans that are long enough and in the text."""
    body = T.normalise(text)
    shown = (F.size(spans) > 0) & F.forall(spans, lambda s: (F.length(T.normalise(s)) >= LEAST_SPAN) & F.contains(body, T.normalise(s)))
    return F.when(level == "none", F.size(F.coalesce(spans, F.array().cast("array<string>"))) == 0).when(level.isin("full", "partial"), F.coalesce(shown, F.lit(False))).otherwise(False)


def audit(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fact_id, chunk_id, support_level, match_kind, evidence_spans) of pairs (fact_id, chunk_id, spans, text, ...) with full or partial support.

    Exact overlap is full support. The others go to the judge, from pairs to (fact_id, chunk_id, support_level, evidence_spans); a judgment that is missing or not valid supports nothing.
    """
    seen = audit_exact(pairs).join(pairs, ["fact_id", "chunk_id"])
    exact = seen.filter("match_kind = 'exact_overlap'").select("fact_id", "chunk_id", "support_level", "match_kind", F.col("spans").alias("evidence_spans"))
    open_ = seen.filter("match_kind = 'judge'").drop("support_level", "match_kind")
    told = judge(open_).select("fact_id", "chunk_id", F.col("support_level").alias("level"), "evidence_spans").dropDuplicates(["fact_id", "chunk_id"])
    both = open_.join(told, ["fact_id", "chunk_id"]).filter(valid_judgment(F.col("level"), F.col("evidence_spans"), F.col("text"))).filter("level <> 'none'")
    return exact.unionByName(both.select("fact_id", "chunk_id", F.col("level").alias("support_level"), F.lit("semantic_equivalent").alias("match_kind"), "evidence_spans"))


def duplication_scope(gold: DataFrame) -> DataFrame:
    """(fact_id, n_gold, scope, multiplicity) of gold (fact_id, doc_id), a row for each gold chunk, the primary one among them."""
    per = gold.groupBy("fact_id", "doc_id").agg(F.count("*").alias("n")).groupBy("fact_id").agg(F.sum("n").alias("n_gold"), F.count("*").alias("docs"), F.max("n").alias("most"))
    scope = F.when(F.col("n_gold") == 1, "unique").when(F.col("docs") == 1, "same_document").when(F.col("most") > 1, "mixed").otherwise("cross_document")
    return per.select("fact_id", "n_gold", scope.alias("scope"), F.when(F.col("n_gold") > 1, "multi").otherwise("single").alias("multiplicity"))


def valid_item(text: Column, answer: Column, spans: Column, queries: Column, styles: Column, forbidden: tuple[str, ...], wanted: tuple[str, ...] = STYLES) -> Column:
    """Whether a generated item holds: a question of each wanted style and no other, each ending in a question mark, unique and long enough, without forbidden phrases; the answer long enough; spans long enough and in the text."""
    body = T.normalise(text)
    asked = F.transform(queries, T.normalise)
    return (
        (F.size(queries) == len(wanted)) & (F.array_sort(styles) == F.array(*map(F.lit, sorted(wanted)))) & (F.length(T.strip(answer)) >= LEAST_ANSWER) & (F.size(spans) > 0)
        & F.forall(spans, lambda s: (F.length(T.collapse(s)) >= LEAST_SPAN) & F.contains(body, T.normalise(s)))
        & F.forall(asked, lambda q: (F.length(q) >= LEAST_QUERY) & F.endswith(q, F.lit("?"))) & (F.size(F.array_distinct(asked)) == F.size(asked))
        & ~F.exists(asked, lambda q: F.exists(F.array(*map(F.lit, forbidden)), lambda p: F.contains(q, p)))
    )


def assemble_cases(groups: DataFrame) -> DataFrame:
    """Numbered cases of groups (group_key, multiplicity, n_questions, questions ARRAY<STRUCT<style, query>>): groups of two drop the style `lexical`."""
    placed = in_order(groups, ["multiplicity", "group_key"], "_group")
    first = placed.groupBy("multiplicity").agg(F.min("_group").alias("_first"))
    asked = F.when(F.col("n_questions") == 2, F.filter("questions", lambda q: q["style"] != "lexical")).otherwise(F.col("questions"))
    numbered = placed.join(F.broadcast(first), "multiplicity").withColumn("group_id", F.format_string("%s_%03d", "multiplicity", F.col("_group") - F.col("_first") + 1))  # a row for each multiplicity
    rows = numbered.select("group_id", "group_key", "multiplicity", "_group", F.posexplode(asked).alias("at", "q"))
    total = in_order(rows, ["_group", "at"], "_case")
    return total.select(F.format_string("ret_%03d", F.col("_case") + 1).alias("case_id"), "group_id", "group_key", "multiplicity", F.col("q.style").alias("paraphrase_type"), F.col("q.query").alias("query"))


def first_occurrence(rows: DataFrame, text: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows whose text comes for the first time, case and white space aside."""
    return ranked(rows.withColumn("_norm", T.normalise(text)), [*(by or []), "_norm"], order, "_at").filter("_at = 1").drop("_at", "_norm")


def spread_first(index: Column, n: Column, k: Column) -> Column:
    """Whether an index from 0 is one of i * n div k for i below k: the first such index not below it is itself."""
    i = F.ceil(index * k / n)
    return (i < k) & (F.floor(i * n / k) == index)


def even_spread(rows: DataFrame, index: str, n: int, k: int) -> DataFrame:
    """rows with `place`: those at indexes i * n div k come first, the others after, each in order. index: 0 to n - 1, each once; so the indexes before a row tell its place, and nothing is sorted."""
    if not k or not n or k >= n:
        return rows.withColumn("place", (F.col(index) + 1).cast("int"))
    firsts = F.ceil(F.col(index) * k / n)  # first indexes below this one
    return rows.withColumn("place", F.when(spread_first(F.col(index), F.lit(n), F.lit(k)), firsts + 1).otherwise(F.lit(k) + F.col(index) - firsts + 1).cast("int"))
