"""The jobs as queries: each runs its function twice over the whole tables into one new folder, and returns what stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import index_documents, retrieval_baselines
from lodestone.plans.catalog import GOLD, TOK, WORDS
from lodestone.sources.staging import folder


def _new(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the index of all documents."""
    at = _new(spark, "job1")
    for _ in range(2):
        store = index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    return store.postings().select("doc_id", "term", "tf", "dl", "source")


def job2_retrieval_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the three baselines over all questions and documents."""
    at = _new(spark, "job2")
    for _ in range(2):
        report = retrieval_baselines.run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", at)
    return report


QUERIES = {"job1_index_documents": job1_index_documents, "job2_retrieval_baselines": job2_retrieval_baselines}

_BASELINES = ", ".join(f"('{b['id']}', {b['k1']}::double, {b['b']}::double)" for b in retrieval_baselines.DEFAULTS["baselines"])
_FIRST, _SECOND = retrieval_baselines.DEFAULTS["word_classes"]
ORACLES = {
    "job1_index_documents": f"with w as (select doc_id, source, {TOK.format('text')} as w from documents) select doc_id, term, count(*) as tf, dl, source from (select doc_id, source, len(w)::bigint as dl, unnest(w) as term from w) group by doc_id, term, dl, source",
    "job2_retrieval_baselines": f"""with {GOLD}, cfg(baseline, k1, b) as (values {_BASELINES}),
tok as (select doc_id, {TOK.format('text')} as w from documents), len as (select doc_id, len(w) as dl from tok), st as (select count(*) as n, avg(dl) as mean from len),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from tok) group by doc_id, term), df as (select term, count(*) as df from tf group by term),
q as (select distinct item_id as case_id, unnest({TOK.format('text')}) as term from benchmark),
bm as (select baseline, case_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))), 6) as score from q join df using (term) join tf using (term) join len using (doc_id), st, cfg group by baseline, case_id, doc_id),
hits as (select baseline, case_id, doc_id as chunk_id, row_number() over (partition by baseline, case_id order by score desc, doc_id) as rank from bm),
ng as (select case_id, count(*) as g from gold group by case_id),
m as (select baseline, case_id, min(rank) filter (grade = 2) as first, count(*) filter (grade = 2) as f, coalesce(sum((2 ** grade - 1) / log2(rank + 1)), 0) as d from hits join graded using (case_id, chunk_id) where rank <= 10 group by baseline, case_id),
ideal as (select case_id, sum((2 ** grade - 1) / log2(nth + 1)) filter (nth <= 10) as i from (select case_id, grade, row_number() over (partition by case_id order by grade desc, chunk_id) as nth from graded) group by case_id),
cases as (select item_id as case_id, baseline, case when {WORDS.format("coalesce(text, '')")} <= {_FIRST} then 'up to-{_FIRST}' when {WORDS.format("coalesce(text, '')")} <= {_SECOND} then 'up to-{_SECOND}' else 'over-{_SECOND}' end as length from benchmark, cfg),
s as (select baseline, case_id, length, (coalesce(f, 0) > 0)::int::double as hit_10, round(coalesce(f / g, 0), 6)::double as recall_10, round(coalesce(d / i, 0), 6)::double as ndcg_10, round(coalesce(1.0 / first, 0), 6)::double as mrr
  from cases left join m using (baseline, case_id) left join ng using (case_id) left join ideal using (case_id)),
r as (select baseline, case when grouping(length) = 0 then 'length' else 'all' end as dimension, case when grouping(length) = 0 then length else 'all' end as value, count(*) as n,
  round(avg(hit_10), 6) as hit_10, round(avg(recall_10), 6) as recall_10, round(avg(ndcg_10), 6) as ndcg_10, round(avg(mrr), 6) as mrr from s group by grouping sets ((baseline), (baseline, length)))
select r.*, round(r.mrr - o.mrr, 6) as delta_mrr from r left join r o on o.baseline = '{retrieval_baselines.DEFAULTS["reference"]}' and o.dimension = r.dimension and o.value = r.value""",
}
