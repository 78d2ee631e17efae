"""Retrieval and end-to-end metrics and their grouped reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.common import ranked, small
from lodestone.sources.staging import staged

KS = (1, 3, 5, 10)


def graded(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """hits (case_id, chunk_id, rank) with the grade of qrels (case_id, chunk_id, grade): 2 full, 1 partial, 0 else; the best grade counts."""
    best = qrels.groupBy("case_id", "chunk_id").agg(F.max("grade").alias("grade"))
    return hits.join(best, ["case_id", "chunk_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def score_rankings(cases: DataFrame, hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of cases (case_id, ...) with hit_k, recall_k, ndcg_k and mrr; a case without gold or hits has zeros. by: columns of cases and hits, but not of qrels, that tell rankings apart.

    Recall and hits count full support alone, nDCG partial support as half the grade; its ideal ranking has all graded chunks, best first.
    """
    seen = graded(hits, qrels)
    full = F.col("grade") == 2
    per = [F.max(F.when(full & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit_{k}") for k in ks]
    per += [F.count(F.when(full & (F.col("rank") <= k), 1)).alias(f"found_{k}") for k in ks]
    per += [F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}") for k in ks]
    mine = seen.groupBy(*by, "case_id").agg(*per, F.min(F.when(full, F.col("rank"))).alias("first"))
    best = qrels.groupBy("case_id", "chunk_id").agg(F.max("grade").alias("grade"))
    ideal = ranked(best, ["case_id"], [F.col("grade").desc(), "chunk_id"], "at")
    ideal = ideal.groupBy("case_id").agg(F.count(F.when(F.col("grade") == 2, 1)).alias("gold"), *(F.sum(F.when(F.col("at") <= k, _gain(F.col("grade"), F.col("at"))).otherwise(0.0)).alias(f"idcg_{k}") for k in ks))
    both = cases.join(ideal, "case_id", "left").join(mine, [*by, "case_id"], "left")
    out = [c for c in cases.columns]
    zero = F.lit(0.0)
    for k in ks:
        both = both.withColumn(f"hit_{k}", F.coalesce(f"hit_{k}", F.lit(0)).cast("double")).withColumn(f"recall_{k}", F.round(F.coalesce(F.col(f"found_{k}") / F.nullif("gold", F.lit(0)), zero), 6)).withColumn(f"ndcg_{k}", F.round(F.coalesce(F.col(f"dcg_{k}") / F.nullif(f"idcg_{k}", zero), zero), 6))
    names = [f"{m}_{k}" for m in ("hit", "recall", "ndcg") for k in ks]
    return both.select(*out, *names, F.round(F.coalesce(1.0 / F.col("first"), zero), 6).alias("mrr"))


def metric_groups(scored: DataFrame, dimensions: list[str], metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(dimension, value, n, means): over all (`all`), and over each value of each dimension, in one pass of grouping sets; for each value of the columns `by`, which come first."""
    sets = [[*by], *([*by, d] for d in dimensions)]
    grouped = scored.groupingSets(sets, *by, *dimensions).agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in metrics), *(F.grouping(d).alias(f"g_{d}") for d in dimensions))
    name = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dimensions), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("None"))) for d in dimensions), F.lit("all"))
    return grouped.select(*by, name.alias("dimension"), value.alias("value"), "n", *metrics)


def weakest(scored: DataFrame, by: str, metrics: list[str], k: int = 5) -> DataFrame:
    """The k worst cases of each group, by the metrics in turn; a null is worse than any value, ties keep the order of case_id."""
    return ranked(scored, [by], [*(F.col(m).asc_nulls_first() for m in metrics), F.col("case_id").asc()], "place").filter(F.col("place") <= k)


def score_citations(cases: DataFrame, cited: DataFrame) -> DataFrame:
    """cases (case_id, primary_id, gold ARRAY) with counts and scores of cited (case_id, chunk_id), a multiset; precision is null where nothing is cited."""
    mine = cited.groupBy("case_id").agg(F.collect_list("chunk_id").alias("ids"))
    both = cases.join(mine, "case_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>" if dict(cited.dtypes)["chunk_id"] == "bigint" else "array<string>")))
    good = F.size(F.filter("ids", lambda i: F.array_contains("gold", i)))
    return both.select(
        "case_id", F.size("ids").cast("long").alias("citation_count"), good.cast("long").alias("correct_citation_count"), F.round(good / F.nullif(F.size("ids"), F.lit(0)), 6).alias("citation_precision"),
        (good > 0).cast("int").alias("citation_hit"), F.coalesce(F.array_contains("ids", F.col("primary_id")), F.lit(False)).cast("int").alias("primary_citation_hit"),
    )


ANSWERED = ("answered", "answered_partial")


def e2e_measures() -> list[Column]:
    """Aggregates of end-to-end rows: rates, micro precision over citations, macro precision over rows that cite."""
    share = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return [
        F.count("*").alias("n"), share((F.col("status") == "answered").cast("double"), "fully_answered_rate"),
        share(((F.col("status") == "answered") & (F.col("citation_hit") == 1)).cast("double"), "grounded_success_rate"), share(F.col("citation_hit").cast("double"), "citation_hit_rate"),
        F.round(F.coalesce(F.sum("correct_citation_count") / F.nullif(F.sum("citation_count"), F.lit(0)), F.lit(0.0)), 6).alias("precision_micro"),
        F.round(F.coalesce(F.avg("citation_precision"), F.lit(0.0)), 6).alias("precision_macro"), share("rounds", "mean_rounds"), share("latency_s", "mean_latency_s"),
    ]


def e2e_groups(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    sets = [[], *([d] for d in dimensions)]
    grouped = rows.groupingSets(sets, *dimensions).agg(*e2e_measures(), *(F.grouping(d).alias(f"g_{d}") for d in dimensions))
    name = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dimensions), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")) for d in dimensions), F.lit("all"))
    return grouped.select(name.alias("dimension"), value.alias("value"), *[c for c in grouped.columns if c not in dimensions and not c.startswith("g_")])


def e2e_overall(rows: DataFrame) -> DataFrame:
    answered = F.col("status").isin(*ANSWERED)
    return rows.agg(
        *e2e_measures(), F.round(F.avg((F.col("category") == "in_scope").cast("double")), 6).alias("in_scope_rate"), F.round(F.avg(answered.cast("double")), 6).alias("answer_produced_rate"),
        F.round(F.coalesce(F.avg("integrity"), F.lit(0.0)), 6).alias("integrity_rate"), F.round(F.coalesce(F.avg(F.when(answered, (F.col("citation_count") == 0).cast("double"))), F.lit(0.0)), 6).alias("uncited_answer_rate"),
    )


#: Values of a group up to which its median and percentile are taken in memory; larger groups are narrowed. Ranges of a round.
IN_MEMORY, SPLITS = 1_000_000, 1024


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], splits: int = SPLITS) -> DataFrame:
    """(by..., a column for each of ranks): the values that stand at these ranks, from 1, of a group's finite values in ascending order. ranks: from a group's number of values to a rank.

    No group is sorted or held: in each round the range that has the rank is cut into `splits` ranges of equal width, whose rows are counted, and the one that has it is shrunk to the values in it, until they are equal.
    A round's counts are summed where rows lie; the ranges, one for each group and rank, are written down.
    """
    good = rows.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    sizes = good.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items())))
    open_ = staged(sizes.select(*by, "lo", "hi", each.alias("r")).select(*by, "lo", "hi", "r.name", "r.rank"))
    found = [open_.filter("lo = hi")]
    open_ = open_.filter("lo < hi")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    while open_.limit(1).count():
        at = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * splits  # halves, so that no difference overflows
        inside = good.alias("a").join(small(open_).alias("b"), [*same, F.col("_v").between(F.col("lo"), F.col("hi"))])
        counts = inside.groupBy(*(F.col(f"b.{c}") for c in by), "name", "rank", F.least(F.floor(at), F.lit(splits - 1)).alias("at")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by, "name").orderBy("at"))  # `splits` rows at most
        one = counts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("n") < F.col("rank")))
        open_ = staged(one.select(*by, "lo", "hi", "name", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank")))
        found.append(open_.filter("lo = hi"))
        open_ = open_.filter("lo < hi")
    done = reduce(DataFrame.unionByName, found)
    return done.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in ranks))


def latency(rows: DataFrame, by: list[str], value: str, order: str, in_memory: int = IN_MEMORY) -> DataFrame:
    """Mean, median, nearest-rank 95th percentile, largest, and the mean without the first row by `order` (which counts where it is alone). Groups of more than in_memory values get median and percentile by at_ranks()."""
    # the first row's share is taken off the sums, in the one aggregate
    n, first = F.count(value), F.min_by(value, order)
    later = F.when(n > F.when(first.isNotNull(), 1).otherwise(0), (F.sum(value) - F.coalesce(first, F.lit(0.0))) / F.nullif(n - F.when(first.isNotNull(), 1).otherwise(0), F.lit(0)))
    means = [F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_s")]
    ends = [F.max(value).alias("max_s"), F.round(F.coalesce(later, F.avg(value)), 6).alias("mean_excluding_first_s")]
    most = rows.groupBy(*by).agg(n.alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= in_memory:
        return rows.groupBy(*by).agg(*means, F.round(F.median(value), 6).alias("median_s"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95_s"), *ends)
    ranks = at_ranks(rows, by, value, {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1, "p95_s": lambda n: F.ceil(n * 0.95)}).alias("r")
    groups = rows.groupBy(*by).agg(*means, *ends).alias("g")
    both = groups.join(ranks, [F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], "left")
    return both.select(*(f"g.{c}" for c in by), "n", "mean_s", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median_s"), "p95_s", "max_s", "mean_excluding_first_s")


DECLINED = ("insufficient", "rejected", "needs_clarification")


def smoke_rows(cases: DataFrame, states: DataFrame) -> DataFrame:
    """A row for each of cases (id, query, expected_category, expected_sources, must_include, expect_insufficient) with its state (query_id, category, status, rounds, response, confidence, citations, dropped): how
    triage, sources, keywords and abstention came out. A case without a state is an error."""
    s = states.withColumnRenamed("query_id", "id")
    both = cases.join(s, "id", "left").withColumn("status", F.coalesce("status", F.lit("error")))
    cited = F.transform(F.coalesce("citations", F.array().cast("array<struct<source:string>>")), lambda c: c["source"])
    abstained = F.col("status").isin(*DECLINED, "answered_partial")
    return both.select(
        "id", "query", "expected_category", F.coalesce("category", F.lit("")).alias("actual_category"), F.coalesce(F.col("category") == F.col("expected_category"), F.lit(False)).cast("int").alias("triage_correct"), "status", F.coalesce("rounds", F.lit(0)).alias("rounds"),
        F.size(cited).alias("n_citations"), F.array_join(F.array_sort(F.array_distinct(cited)), "|").alias("cited_sources"), T.source_hit(cited, F.coalesce("expected_sources", F.array().cast("array<string>"))).alias("source_hit"),
        T.source_precision(cited, F.coalesce("expected_sources", F.array().cast("array<string>"))).alias("source_precision"), T.keyword_recall(F.coalesce("response", F.lit("")), F.coalesce("must_include", F.array().cast("array<string>"))).alias("keyword_recall"),
        F.coalesce("confidence", F.lit("")).alias("confidence"), (F.size(F.coalesce("dropped", F.array())) == 0).cast("int").alias("citation_integrity"), F.when(F.col("expect_insufficient"), abstained.cast("int")).alias("abstained"), F.substring(F.coalesce("response", F.lit("")), 1, 2000).alias("response"),
    )


def smoke_summary(rows: DataFrame) -> DataFrame:
    """Means over what is not null of rows (triage_correct, source_hit, source_precision, keyword_recall, abstained, status, n_citations)."""
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.agg(F.count("*").alias("n"), mean("triage_correct").alias("triage_accuracy"), mean("source_hit").alias("source_hit"), mean("source_precision").alias("source_precision"), mean("keyword_recall").alias("keyword_recall"), mean("abstained").alias("abstention"), mean(F.when(F.col("status").isin(*ANSWERED), F.col("n_citations"))).alias("mean_citations"))
