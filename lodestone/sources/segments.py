"""A search index that grows: each upsert adds a segment of Parquet partitions, and what it replaces is told by rows, not by rewriting older ones.

Tables under one folder, each partitioned by segment: `documents` (chunk_id, the chunk's columns, dl), `postings` (term, and the lists doc_id, tf, dl, source), made where documents lie, for runs of them in which terms ascend, so that no posting is shuffled, a term is
found in few row groups of a file and a frequent one is spread over files; `replaced` (chunk_id, of, dl), the rows of older segments that no longer hold; `totals`, one row, which is written last. A segment without totals doesn't count, and writing
a segment again replaces it, so an upsert that failed is simply repeated. Statistics are sums over totals and replaced. Where chunks have a vector, `vectors` (doc_id, vector, source, list, part) and `lists` (list, centre, radius, n) hold them by nearest centre, for exact dense search.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions import text as T
from lodestone.operators import lists, retrieval
from lodestone.operators.common import fits, ranked, small
from lodestone.sources.staging import staged

COLUMNS = {
    "documents": "chunk_id long, text string, source string, dl long, segment int", "postings": "term string, doc_id array<long>, tf array<int>, dl array<int>, source array<string>, segment int",
    "vectors": "doc_id long, vector array<double>, source string, list int, part int, segment int", "lists": "list int, centre array<double>, radius double, n long, segment int"}
TOTALS = "n long, dl long, n_replaced long, dl_replaced long, segment int"
#: Different terms of queries up to which their ranges are pushed to the scan, and how many ranges.
PUSHED_TERMS, RANGES = 10_000, 32
#: Lists of a row group of postings, at most: a run of documents fills several, of which each has few terms.
GROUP = 1 << 14


class Segments:
    """Upserts, deletions and BM25 over the segments in a folder; chunks have chunk_id, text and, if they like, source and other columns, the same ones in each upsert."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str, own: bool = False) -> DataFrame:
        """A table, without rows if nothing was written yet; own: with the columns that it was written with."""
        try:
            return (self.spark.read if own else self.spark.read.schema(schema)).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """(segment, n, dl, n_replaced, dl_replaced) of each segment that counts."""
        return self._read("totals", TOTALS)

    def numbers(self) -> list[int]:
        """The segments that count; merged() keeps them few."""
        return sorted(r["segment"] for r in self.totals().select("segment").collect())

    def _table(self, name: str, numbers: list[int]) -> DataFrame:
        return self._read(name, COLUMNS[name], own=True).filter(F.col("segment").isin(numbers))

    def _replaced(self, numbers: list[int], key: str) -> DataFrame:
        return self._read("replaced", f"chunk_id {key}, of int, dl long, segment int").filter(F.col("segment").isin(numbers))

    def _live(self, rows: DataFrame, id_col: str, numbers: list[int]) -> DataFrame:
        """Rows that no later segment has replaced."""
        gone = small(self._replaced(numbers, dict(rows.dtypes)[id_col]).select(F.col("chunk_id").alias(id_col), F.col("of").alias("segment")).distinct())
        return rows.join(gone, [id_col, "segment"], "left_anti")

    def exists(self) -> bool:
        return bool(self.numbers())

    def count(self) -> int:
        return self.documents().count() if self.exists() else 0

    def _held(self, numbers: list[int]) -> DataFrame:
        return self._live(self._table("documents", numbers), "chunk_id", numbers)

    def _vectors(self, numbers: list[int]) -> DataFrame:
        return self._live(self._table("vectors", numbers), "doc_id", numbers)

    def documents(self) -> DataFrame:
        """The chunks that hold, with dl and the segment of each."""
        return self._held(self.numbers())

    def postings(self) -> DataFrame:
        """(doc_id, term, tf, dl, source, segment) of the chunks that hold."""
        return self._postings(self.numbers(), self._table("postings", self.numbers()))

    def _postings(self, numbers: list[int], lists: DataFrame) -> DataFrame:
        return self._live(retrieval.unlisted(lists), "doc_id", numbers)

    def stats(self) -> DataFrame:
        """One row: n and mean_dl of the chunks with text that hold, summed up from the segments."""
        n, dl = F.sum(F.col("n") - F.col("n_replaced")), F.sum(F.col("dl") - F.col("dl_replaced"))
        return self.totals().agg(F.coalesce(n, F.lit(0)).alias("n"), (dl / F.nullif(n, F.lit(0))).alias("mean_dl"))

    def _place(self, segment: int | None) -> tuple[list[int], int]:
        """The segments before a new one, or before the last one that is written again, and its number. ValueError for a number that later ones follow."""
        there = self.numbers()
        segment = (there[-1] + 1 if there else 0) if segment is None else segment
        if there and segment < there[-1]:
            raise ValueError(f"segment {segment} is older than {there[-1]}")
        return [s for s in there if s < segment], segment

    def _write(self, df: DataFrame, name: str, segment: int, **options) -> None:
        df.withColumn("segment", F.lit(segment)).write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy("segment").parquet(f"{self.folder}/{name}")

    def upsert(self, chunks: DataFrame, segment: int | None = None, newest: list[Column | str] | None = None, whole: bool = False, vectors: DataFrame | None = None) -> int:
        """Add chunks as a segment, by default one after the last, and return its number. Chunks with these ids are replaced, whatever segment has them; others are untouched. Of rows that share an id the first by
        `newest` holds, then the largest text, which costs a shuffle of whole chunks only where ids repeat; rows without an id are left out; a chunk without text is held, but counts in no statistic, as in retrieval.bm25(). The number of the last segment writes that one again; an older one is a ValueError. Without rows the segment is empty. whole: nothing else holds from
        then on. vectors: those of chunks, (chunk_id, vector), as a table of its own, so that texts need not be joined with them; one whose id chunks lack is of a chunk without text."""
        before, segment = self._place(segment)
        one = _one(chunks.filter("chunk_id is not null"), [*(newest or []), F.col("text").desc_nulls_last()])
        one = one if "source" in one.columns else one.withColumn("source", F.lit(""))
        if vectors is not None:
            vectors = _one(vectors.select("chunk_id", "vector").filter("chunk_id is not null"), [F.col("vector").desc_nulls_last()])
            one = one.unionByName(vectors.select("chunk_id").join(one.select("chunk_id"), "chunk_id", "left_anti"), allowMissingColumns=True)
        self._write(one.withColumn("dl", F.when(F.col("text").isNotNull(), F.size(T.token_list("text"))).cast("long")), "documents", segment)
        mine = self._table("documents", [segment])
        words = mine.select(F.col("chunk_id").alias("doc_id"), T.token_list("text").alias("w"), "source")
        self._write(retrieval.listed(words), "postings", segment, **{"parquet.block.row.count.limit": GROUP})
        if vectors is not None or "vector" in one.columns:
            # texts are not read for it, and what joins vectors is done once, not for each step of build()
            apart = mine.select("chunk_id", "vector", "source") if vectors is None else staged(vectors.join(mine.select("chunk_id", "source"), "chunk_id"))
            made, placed = lists.build(apart.withColumnRenamed("chunk_id", "doc_id"))
            self._write(placed.repartitionByRange("list", "part").sortWithinPartitions("list", "part"), "vectors", segment)
            self._write(made, "lists", segment)
        self._replace(None if whole else mine.select("chunk_id"), before, segment)
        self._count(mine, segment)
        return segment

    def delete(self, ids: DataFrame, segment: int | None = None) -> int:
        """Chunks with an id of ids (chunk_id) hold no longer; the number of the segment that says so."""
        before, segment = self._place(segment)
        self._replace(ids.select("chunk_id").filter("chunk_id is not null").distinct(), before, segment)
        self._count(None, segment)
        return segment

    def _replace(self, ids: DataFrame | None, before: list[int], segment: int) -> None:
        if before:
            held = self._held(before).select("chunk_id", F.col("segment").alias("of"), "dl")
            self._write(held if ids is None else held.join(small(ids), "chunk_id", "left_semi"), "replaced", segment)

    def _count(self, mine: DataFrame | None, segment: int) -> None:
        sums = [F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"), F.count("dl").alias("n")]
        n, dl = (mine.agg(*sums).select("n", "dl").first()) if mine is not None else (0, 0)
        gone = self._replaced([segment], "string").select("dl").agg(*sums).first()
        self._write(self.spark.createDataFrame([(n, dl, gone["n"], gone["dl"])], "n long, dl long, n_replaced long, dl_replaced long"), "totals", segment)

    def search(self, queries: DataFrame, sources: list[str] | None = None, query_text: str = "query", **how) -> DataFrame:
        """What retrieval.bm25() gives for queries over the chunks that hold. Where the queries have few different terms, their ranges go down to the scan of the sorted postings."""
        terms = queries.select(F.explode(F.array_distinct(T.token_list(query_text))).alias("term")).distinct()
        numbers = self.numbers()
        found = self._table("postings", numbers)
        if fits(terms, PUSHED_TERMS):
            found = _of(found, [(r["term"],) for r in terms.collect()], "term string")  # PUSHED_TERMS at most
        return retrieval.bm25_stored(queries, self._postings(numbers, found), self.stats(), sources=sources, query_text=query_text, **how)

    def top(self, queries: DataFrame, k: int, settings: Settings = DEFAULTS, sources: list[str] | None = None, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """What retrieval.top_hits(search(...), k) gives: (query_id, doc_id, score, rank). The lists of the asked terms are turned into rows of documents, those that no longer hold go, and the rest are scored where they lie; no posting meets
        every query that asks for it in a shuffle. Where the queries are too many to be sent to the tasks, it is search()."""
        asked, pairs = retrieval.asked_pairs(queries, query_id, query_text)
        numbers = self.numbers()
        lists_ = self._table("postings", numbers)
        if not pairs or dict(lists_.dtypes)["doc_id"] not in ("array<string>", "array<bigint>", "array<int>"):
            return retrieval.top_hits(self.search(queries, sources, query_text, settings=settings, query_id=query_id), k)
        terms = sorted({r["term"] for r in pairs})
        found = retrieval.by_document(_of(lists_, list(zip(terms, range(len(terms)), strict=True)), "term string, code int"))
        stats = self.stats().first()
        return retrieval.by_document_top(staged(self._live(found, "doc_id", numbers)), asked, pairs, terms, stats["n"], stats["mean_dl"], k, settings, sources)

    def dense(self, queries: DataFrame, k: int, sources: list[str] | None = None) -> DataFrame:
        """The k best dot products with the vectors of chunks that hold, for queries (query_id, vector): what retrieval.dense() and top_hits() give. Lists that cannot have one of them are not looked into."""
        numbers = self.numbers()
        vectors = self._vectors(numbers)
        return lists.search(queries, self._table("lists", numbers), vectors.filter(F.col("source").isin(sources)) if sources else vectors, k, staged)

    def hybrid(self, queries: DataFrame, settings: Settings = DEFAULTS, sources: list[str] | None = None) -> DataFrame:
        """Both branches over queries (query_id, query, vector), fused; a query without a vector has no dense list."""
        return retrieval.hybrid(self.top(queries, settings.top_k_sparse, settings, sources).drop("rank"), self.dense(queries, settings.top_k_dense, sources).drop("rank"), settings)

    def merged(self, folder: str) -> Segments:
        """The chunks that hold, as one segment of a new folder."""
        out = Segments(self.spark, folder)
        held, vectors = self.documents().drop("dl", "segment"), self._vectors(self.numbers())
        apart = vectors.select(F.col("doc_id").alias("chunk_id"), "vector") if "vector" not in held.columns and vectors.limit(1).count() else None
        out.upsert(held, vectors=apart)
        return out


def _one(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Of rows that share a chunk_id the first by order; without a shuffle of whole rows where none do."""
    if not rows.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        return rows
    return ranked(rows, ["chunk_id"], order, "_at").filter("_at = 1").drop("_at")


def _of(lists_: DataFrame, terms: list[tuple], schema: str) -> DataFrame:
    """The lists of terms, rows of schema, with what else these have."""
    return lists_.filter(ranges([t[0] for t in terms])).join(F.broadcast(lists_.sparkSession.createDataFrame(terms, schema)), "term")


def ranges(terms: list[str], most: int = RANGES) -> Column:
    """A condition on the column term that all of terms fulfil, and few others: at most so many ranges between neighbours of them."""
    ordered = sorted(set(terms), key=lambda t: t.encode())
    size = max(1, -(-len(ordered) // most))
    out = F.lit(False)
    for at in range(0, len(ordered), size):
        out = out | F.col("term").between(ordered[at], ordered[min(at + size, len(ordered)) - 1])
    return out
