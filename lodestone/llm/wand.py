"""Ranked lexical search by WAND: integer scores, one pass of cursors over documents for each query in each shard, heaps that a task keeps from shard to shard.

An index is that of lodestone.llm.search, of which block maxima are not read. Before a shard is searched, the impacts of the asked terms' postings and the largest impact of each term are computed from the statistics of the
whole index. Every term of a query has a cursor on its documents; the pivot is the first document, in the order of the cursors, up to which the terms' largest impacts add up to the k-th best score so far.
Documents before it cannot reach that score and are skipped. A task keeps each query's heap from one shard to the next, and the heaps of all tasks are merged.

N, L, df, tf and n below: documents with a term, all their terms, documents that hold a term, its occurrences in a document, a document's terms. A term weighs floor(1000 ln((2N + 2) / (2df + 1))); a document's score sums
weight * (1000000000 tf div (1000 tf + 8m)) over the query's terms, repeats included, where m = 25 + (75nN div L). Terms are 64-bit hashes of words; of 1e9 words and 1e4 asked terms two are the same with probability 1e-6.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import batches, mapped, runs, signed, table, written
from lodestone.llm.search import QUERY_TERMS, TOP, _loaded, _postings, build_index, stored

#: What is read of an index.
INDEX = ("ids", "lengths", "terms", "first", "docs", "counts")
_END = 1 << 62


def best(lists: list[tuple[list[int], list[int], int, int]], ids: list[int], heap: list[tuple[int, int]], k: int) -> int:
    """Put the documents of a shard that are among the k best so far into heap, as (score, -id), smallest first; how many were scored.

    lists: for each term its documents, ascending and then _END; their impacts; the largest of them, and the term's weight in the query.
    """
    cursors = [[docs[0], 0, docs, impacts, most * weight, weight] for docs, impacts, most, weight in lists]
    theta, scored = heap[0][0] if len(heap) == k else 1, 0
    while True:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0, _END
        for c in cursors:
            total += c[4]
            if total >= theta:
                pivot = c[0]
                break
        if pivot == _END:
            return scored
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                at = c[1]
                score += c[3][at] * c[5]
                c[1] = at + 1
                c[0] = c[2][at + 1]
            scored += 1
            if len(heap) < k:
                heapq.heappush(heap, (score, -ids[pivot]))
            else:
                heapq.heappushpop(heap, (score, -ids[pivot]))
            if len(heap) == k:
                theta = heap[0][0]
        else:
            for c in cursors:
                if c[0] >= pivot:
                    break
                c[1] = bisect_left(c[2], pivot, c[1] + 1)
                c[0] = c[2][c[1]]


def _impacts(x: dict[str, np.ndarray], asked: np.ndarray, n: int, total: int) -> dict[int, tuple[list[int], list[int], int]]:
    """By the place of each asked term that the shard has: its documents and then _END, their impacts, the largest of them."""
    at = np.searchsorted(x["terms"], asked)
    at[at == len(x["terms"])] = 0
    here = np.flatnonzero(x["terms"][at] == asked) if len(x["terms"]) else np.empty(0, int)
    if not len(here):
        return {}
    low = x["first"][at[here]].astype(np.int64)
    size = x["first"][at[here] + 1].astype(np.int64) - low
    p = runs(low, size)
    docs, tf = x["docs"][p].astype(np.int64), x["counts"][p].astype(np.int64)
    m = 25 + np.array([75 * v * n // total for v in x["lengths"].tolist()], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
    ends = np.cumsum(size)
    most = np.maximum.reduceat(impact, ends - size).tolist()
    docs, impact = docs.tolist(), impact.tolist()
    return {t: ([*docs[a:b], _END], impact[a:b], top) for t, a, b, top in zip(here.tolist(), (ends - size).tolist(), ends.tolist(), most, strict=True)}


def search(index: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) of the k documents with the highest scores over 0 for each query, equal scores by the smaller doc_id; index: a stored() build_index(), of which INDEX is read.

    Rows of queries that share an id are one query with the terms of all; those with a null id, a null or empty text or no terms have no result, nor has any over an empty index. Rows of the index that
    share a doc_id are documents of their own, rows without one are not indexed; documents without terms count nowhere. Queries of any length are taken whole, in blocks of about QUERY_TERMS different terms,
    each searched in every shard; what is broadcast and what the driver holds is one block. Other columns of queries are ignored, whatever their names.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            doc, term, count = _postings(batch["text"])
            yield pa.RecordBatch.from_arrays([pa.array(batch["query_id"].to_numpy()[doc], pa.int64()), pa.array(signed(term)), pa.array(count, pa.int64())], ["query_id", "term", "times"])

    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(text_col).cast("string").alias("text")).filter("query_id is not null")
    terms = mapped(asked, cut, "query_id long, term long, times long").groupBy("query_id", "term").agg(F.sum("times").alias("times"))
    parts: list[DataFrame] = []
    block: list[tuple[int, np.ndarray, list[int]]] = []
    size = 0
    for row in terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("terms")).toLocalIterator():
        block.append((row["query_id"], np.array([t["term"] for t in row["terms"]], np.int64).view(np.uint64), [t["times"] for t in row["terms"]]))
        size += len(row["terms"])
        if size >= QUERY_TERMS:
            parts.append(written(_search_block(index, block, k), "ranked"))
            block, size = [], 0
    if block:
        parts.append(written(_search_block(index, block, k), "ranked"))
    if not parts:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score long")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return hits.select("query_id", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def _search_block(index: DataFrame, block: list[tuple[int, np.ndarray, list[int]]], k: int) -> DataFrame:
    """The k best documents of each task's shards for each query of the block."""
    context = index.sparkSession.sparkContext
    own = np.unique(np.concatenate([t for _, t, _ in block]))
    terms = context.broadcast(own)  # about QUERY_TERMS numbers, and one query more

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, df, n, total = terms.value, np.zeros(len(terms.value), np.int64), 0, 0
        for batch in it:
            for i in range(batch.num_rows):
                x = _loaded(batch, i, ("lengths", "terms", "first"))
                n, total = n + int((x["lengths"] > 0).sum()), total + int(x["lengths"].sum())
                if len(x["terms"]):
                    at = np.searchsorted(x["terms"], asked)
                    at[at == len(x["terms"])] = 0
                    df += np.where(x["terms"][at] == asked, np.diff(x["first"].astype(np.int64))[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int32()), pa.array([n, total, *df[some].tolist()], pa.int64())], ["at", "n"])

    found = {r["at"]: r["n"] for r in mapped(index.select("lengths", "terms", "first"), counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block, and two
    n, total = found.pop(-2, 0), found.pop(-1, 0)
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in found.items()}
    weighed = []
    for query, those, times in block:
        at = np.searchsorted(own, those).tolist()
        weighed.append((query, [(t, weights[t] * c) for t, c in zip(at, times, strict=True) if weights.get(t)]))
    sent = context.broadcast(weighed)

    def ranked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, heaps = sent.value, [[] for _ in sent.value]
        for batch in it:
            for i in range(batch.num_rows):
                x = _loaded(batch, i, INDEX)
                have = _impacts(x, terms.value, n, total)
                ids = x["ids"].tolist()
                for (_, weighted), heap in zip(asked, heaps, strict=True):
                    lists = [(*have[t], w) for t, w in weighted if t in have]
                    if lists:
                        best(lists, ids, heap, k)
        rows = [(query, -i, score) for (query, _), heap in zip(asked, heaps, strict=True) for score, i in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "doc_id", "score"])

    return mapped(index.select(*INDEX), ranked, "query_id long, doc_id long, score long")


def op11_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all rows of documents for every row of benchmark: item_id, rank, doc_id, score."""
    index = stored(build_index(table(spark, sf_dir, "documents")).select(*INDEX))
    return search(index, table(spark, sf_dir, "benchmark")).withColumnRenamed("query_id", "item_id")


ORACLE = rf"""
with words as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from documents),
tf as (select doc_id, w, count(*)::bigint as tf from words group by doc_id, w),
len as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
st as (select count(*)::bigint as nn, sum(n)::bigint as ll from len),
df as (select w, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as weight from (select w, count(*)::bigint as df from tf group by w), st),
q as (select item_id, w, count(*)::bigint as times from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark) group by item_id, w),
s as (select item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::bigint as score from q join df using (w) join tf using (w) join len using (doc_id), st group by item_id, doc_id),
r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0)
select * from r where rank <= {TOP}"""
