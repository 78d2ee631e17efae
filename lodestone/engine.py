"""The entry functions: an index of blocks, answers to questions, what an index holds, and runs of many configurations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.operators import chunking, ingest, models, retrieval, workflow
from lodestone.sources import files
from lodestone.sources.segments import Segments


def build_index(spark: SparkSession, blocks: DataFrame, folder: str, settings: Settings = DEFAULTS, sources: DataFrame | None = None, encoder: Callable | None = None) -> Segments:
    """Blocks, with split tables mended, as chunks in a stored index, which hold in place of those that it had. sources: (doc_id, source); without it a document is its own. encoder: loads what turns texts to vectors."""
    chunks = chunking.chunk_blocks(ingest.repair_tables(blocks), settings)
    chunks = chunks.join(sources, "doc_id", "left") if sources is not None else chunks.withColumn("source", F.col("doc_id"))
    store = Segments(spark, folder)
    store.upsert(models.encode(chunks, encoder) if encoder else chunks, whole=True)
    return store


def stored_search(store: Segments, settings: Settings = DEFAULTS, sources: list[str] | None = None, encoder: Callable | None = None, reranker: Callable | None = None) -> Callable[[DataFrame], DataFrame]:
    """A search provider over a stored index. With an encoder, that of the index, both branches are fused, else BM25 stands alone; the best are reranked by the reranker's scores, or by coverage. Both are loaders."""

    def search(asked: DataFrame) -> DataFrame:
        keyed = asked.withColumn("key", F.concat_ws("/", F.col("query_id").cast("string"), F.col("list_no").cast("string")))
        if encoder:
            hits = store.hybrid(models.encode(keyed.select(F.col("key").alias("query_id"), "query"), encoder, "query"), settings, sources)
        else:
            hits = store.top(keyed, settings.top_k_fused, settings, sources, query_id="key")
        texts = store.documents().select(F.col("chunk_id").alias("doc_id"), "text")
        pairs = hits.select(F.col("query_id").alias("key"), "doc_id", "rank").join(keyed.select("key", "query"), "key").join(texts, "doc_id")
        scored = models.score(pairs, reranker) if reranker else pairs.withColumn("rerank_score", retrieval.coverage(F.col("query"), F.col("text")))
        best = retrieval.rerank(scored.select(F.col("key").alias("query_id"), "doc_id", "rank", "rerank_score"), settings, settings.top_k_fused)
        return best.withColumnRenamed("query_id", "key").join(keyed.select("key", "query_id", "list_no"), "key").select("query_id", "list_no", "doc_id", F.col("new_rank").alias("rank"), "rerank_score")

    return search


def answer(questions: DataFrame, store: Segments, providers: workflow.Providers | None = None, settings: Settings = DEFAULTS, triage: Callable | None = None, encoder: Callable | None = None, reranker: Callable | None = None) -> DataFrame:
    """The final state of questions (query_id, query) over a stored index, by the providers or the stand-ins, whose search takes the encoder and the reranker. ValueError if the index is empty."""
    if not store.count():
        raise ValueError("the index is empty")
    none = F.lit(None).cast("string")
    every = triage or (lambda q: q.select("query_id", "query", F.lit("in_scope").alias("category"), F.array().cast("array<string>").alias("search_queries"), none.alias("clarifying_question"), none.alias("rejection_reason")))
    own = providers or workflow.Providers(every, stored_search(store, settings, None, encoder, reranker), workflow.coverage_verdict(support=settings.min_supporting))
    return workflow.run(questions, own if own.chunks is not None else replace(own, chunks=store.documents()), settings)


def index_stats(store: Segments) -> DataFrame:
    """One row: chunks, by kind, documents, sources, and tokens of the smallest, mean and largest chunk."""
    c = store.documents()
    return c.agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_type") == "table").alias("n_tables"), F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("source").alias("n_sources"),
        F.min("n_tokens").alias("min_tokens"), F.expr("sum(n_tokens) div count(*)").alias("mean_tokens"), F.max("n_tokens").alias("max_tokens"),
    )


def sweep(spark: SparkSession, configs: list[dict], cases: DataFrame, run: Callable[[dict, DataFrame], DataFrame], folder: str, key: str = "case_id", version: str = "1.0", manifest_version: str = "1.0") -> DataFrame:
    """(run_id, case_count, errors) of each configuration, whose results stand under folder/<id>. What an earlier call of the same configuration did is not done again.

    run: from a configuration and its open cases to result rows with `key` and error. ValueError for another manifest version or ids that repeat.
    """
    ids = [c["id"] for c in configs]
    if version != manifest_version or len(set(ids)) < len(ids):
        raise ValueError("the manifest has another version" if version != manifest_version else "ids repeat")
    rows = []
    for config in configs:
        path = f"{folder.rstrip('/')}/{config['id']}"
        before = files.read_results(spark, f"{path}/results", key)
        todo = cases if before is None else cases.join(before.filter("error = '' or error is null").select(key), key, "left_anti")
        if todo.limit(1).count():
            files.append_results(run(config, todo), f"{path}/results")
        done = files.read_results(spark, f"{path}/results", key)
        rows.append((config["id"], *(done.agg(F.count("*"), F.count_if(F.coalesce("error", F.lit("")) != "")).first() if done is not None else (0, 0))))
    return spark.createDataFrame(rows, "run_id string, case_count long, errors long")
