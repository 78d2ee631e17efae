"""Exact top-k search by BM25: an inverted index in shards, block-max WAND pruning in each, an exact merge.

A shard is a run of documents of bounded size and one row of the index: for each term its postings, in blocks of the documents of one range, and of each block the largest
frequency and the smallest document length. Document frequencies, the number of documents and their mean length are of the whole index, so
that scores of all shards compare. In a shard every term of a query has a cursor on its blocks. The pivot is the first range, in the order of the cursors, up to which the terms' largest
scores add up to the k-th best score so far; cursors before it move up to it, and it is scored only if the maxima of its blocks add up to that too.
Terms are 64-bit hashes of words; of 1e9 words and 1e4 query terms two are the same with probability 1e-6.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.common import NO_LETTERS, Words, batches, long_text, mapped, runs, signed, stretches, table, written

K1, B, TOP = 1.2, 0.75, 10
#: Text bytes of a shard; documents of a range; distinct terms of the queries that are searched together, which bounds what is broadcast.
SHARD_BYTES, RANGE, QUERY_TERMS = 4 << 20, 64, 200_000
#: Shards of a row group of a written index.
GROUP = 2
_DIGITS = 6
_COLUMNS = (("ids", "<i8"), ("lengths", "<u4"), ("terms", "<u8"), ("first", "<u4"), ("docs", "<u4"), ("counts", "<u4"), ("blocks", "<u4"), ("block", "<u4"), ("block_first", "<u4"), ("most", "<u4"), ("shortest", "<u4"))
_INDEX = "shard long, n long, total long, " + ", ".join(f"{c} binary" for c, _ in _COLUMNS)


def _postings(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term and times of each term of each text, ordered by them; a single long text is read in stretches."""
    long = long_text(text)
    words = [Words(text, lower=True, gaps=NO_LETTERS)] if long is None else (w for w, _, _ in stretches(long, lower=True, gaps=NO_LETTERS))
    parts = [_summed(w.doc, w.hashes, np.ones(len(w.hashes), np.int64)) for w in words]
    return parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _summed(doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, doc))
    doc, term, count = doc[order], term[order], count[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.add.reduceat(count, at) if len(at) else count


def _shard(ids: np.ndarray, doc: np.ndarray, term: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a shard, from postings: document number, term and times."""
    order = np.lexsort((doc, term))
    doc, term, counts = doc[order], term[order], counts[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = term[1:] != term[:-1]
    first = np.append(np.flatnonzero(fresh), len(term))
    lengths = np.bincount(doc, counts, minlength=len(ids)).astype(np.int64)
    block = doc // RANGE
    cut = fresh.copy()
    cut[1:] |= block[1:] != block[:-1]
    at = np.flatnonzero(cut)
    reduced = (lambda f, x: f.reduceat(x, at)) if len(at) else (lambda f, x: x)
    return {"ids": ids, "lengths": lengths, "terms": term[fresh], "first": first, "docs": doc, "counts": counts, "blocks": np.searchsorted(at, first), "block": block[at], "block_first": np.append(at, len(term)), "most": reduced(np.maximum, counts), "shortest": reduced(np.minimum, lengths[doc])}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs, lazily: a row for each shard. Every row of docs with an id is indexed, repeated ids too; a null or empty text has no terms but counts as a document, an empty
    table has no shards. Texts are read whole, very long ones in stretches; one that is longer than a shard makes its own. Other columns are ignored, whatever their names."""

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        ids: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = size = 0

        def made() -> pa.RecordBatch:
            own = _shard(np.concatenate(ids), *(np.concatenate(x) for x in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([int(own["lengths"].sum())], pa.int64()), *(pa.array([own[c].astype(k).tobytes()], pa.binary()) for c, k in _COLUMNS)], ["shard", "n", "total", *(c for c, _ in _COLUMNS)])

        for batch in batches(it, "text", min(common.PASS_BYTES, shard_bytes)):
            doc, term, count = _postings(batch["text"])
            ids.append(batch["id"].to_numpy())
            parts.append((doc + n, term, count))
            n, size = n + batch.num_rows, size + int(pc.sum(pc.fill_null(pc.binary_length(batch["text"]), 0)).as_py())
            if size >= shard_bytes:
                yield made()
                ids.clear()
                parts.clear()
                n, size, shard = 0, 0, shard + 1
        if n:
            yield made()

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null"), build, _INDEX)


def stored(index: DataFrame) -> DataFrame:
    """A build_index() written down, as a search reads it. A task that writes or reads it holds GROUP shards, however many a file has."""
    return written(index, "index", GROUP)


def _loaded(batch: pa.RecordBatch, i: int, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    kinds = dict(_COLUMNS)
    return {c: np.frombuffer(batch[c][i].as_buffer(), kinds[c]) for c in columns}


def _impact(tf: np.ndarray, length: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _best(x: dict[str, np.ndarray], terms: np.ndarray, idf: np.ndarray, mean: float, k: int, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that may be among the k best for a query, with their scores; terms ascend."""
    at = np.searchsorted(x["terms"], terms)
    at[at == len(x["terms"])] = 0
    here = x["terms"][at] == terms if len(x["terms"]) else np.zeros(len(terms), bool)
    own = at[here]
    if not len(own):
        return np.empty(0, int), np.empty(0)
    weight = idf[here]
    low, high = x["blocks"][own].astype(np.int64), x["blocks"][own + 1].astype(np.int64)
    size = high - low
    flat = runs(low, size)
    bound = np.repeat(weight, size) * _impact(x["most"][flat], x["shortest"][flat], mean, k1, b)
    ends = np.cumsum(size)
    begins = ends - size
    most = np.maximum.reduceat(bound, begins).tolist()
    block = x["block"][flat].astype(np.int64)
    cursor, stop, slack = begins.tolist(), ends.tolist(), 10.0**-_DIGITS
    now = block[begins].tolist()  # the range under each term's cursor
    open_ = sorted(range(len(own)), key=now.__getitem__)
    theta, best = 0.0, []
    found_d, found_s = [], []

    def moved(t: int, to: int) -> bool:
        """The cursor of t, at the range `to` or after it; whether there is one."""
        cursor[t] += int(np.searchsorted(block[cursor[t] : stop[t]], to))
        if cursor[t] < stop[t]:
            now[t] = int(block[cursor[t]])
            return True
        return False

    while open_:
        total, pivot = 0.0, -1
        for t in open_:
            total += most[t]
            if total >= theta - slack:
                pivot = now[t]
                break
        if pivot < 0:
            break
        if now[open_[0]] < pivot:  # ranges before the pivot cannot reach the k-th score
            open_ = sorted((t for t in open_ if now[t] >= pivot or moved(t, pivot)), key=now.__getitem__)
            continue
        those = sorted(t for t in open_ if now[t] == pivot)  # in the order of terms, so that equal documents get equal sums
        if sum(float(bound[cursor[t]]) for t in those) >= theta - slack:
            cells = flat[[cursor[t] for t in those]]
            start, n = x["block_first"][cells].astype(np.int64), x["block_first"][cells + 1].astype(np.int64) - x["block_first"][cells]
            p = runs(start, n)
            d = x["docs"][p].astype(np.int64)
            scores = np.bincount(d - pivot * RANGE, np.repeat(weight[those], n) * _impact(x["counts"][p], x["lengths"][d], mean, k1, b), RANGE)
            hit = np.flatnonzero(scores >= max(theta - slack, 1e-300))
            found_d.append(hit + pivot * RANGE)
            found_s.append(scores[hit])
            for s in scores[hit].tolist():
                heapq.heappush(best, s) if len(best) < k else heapq.heappushpop(best, s)
            theta = best[0] if len(best) == k else 0.0
        open_ = sorted((t for t in open_ if now[t] > pivot or moved(t, pivot + 1)), key=now.__getitem__)
    return (np.concatenate(found_d), np.concatenate(found_s)) if found_d else (np.empty(0, int), np.empty(0))


def search(index: DataFrame, queries: DataFrame, k: int = TOP, k1: float = K1, b: float = B, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents with a score over 0 for each query; index: a stored() build_index().

    score is rounded to six places; equal ones go by the smaller doc_id. Rows of queries that share an id are searched as one, with all their distinct words; those with a null id or no words have
    no result; nor has any over an empty index. Rows of the index that share a doc_id are documents of their own. Queries of any length are taken whole, in blocks of bounded size, each
    searched in every shard. Other columns of queries are ignored, whatever their names.
    """
    stats = index.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, mean = stats["n"] or 0, (stats["total"] or 0) / max(stats["n"] or 0, 1)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            doc, term, _ = _postings(batch["text"])
            yield pa.RecordBatch.from_arrays([pa.array(batch["query_id"].to_numpy()[doc], pa.int64()), pa.array(signed(term))], ["query_id", "term"])

    asked = mapped(queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(text_col).cast("string").alias("text")).filter("query_id is not null"), cut, "query_id long, term long").groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    parts: list[DataFrame] = []
    block: list[tuple[int, np.ndarray]] = []

    def searched() -> None:
        parts.append(written(_search_block(index, block, n, mean, k, k1, b), "hits"))

    if n:
        size = 0
        for row in asked.toLocalIterator():
            block.append((row["query_id"], np.sort(np.array(row["terms"], np.int64).view(np.uint64))))
            size += len(row["terms"])
            if size >= QUERY_TERMS:
                searched()
                block, size = [], 0
        if block:
            searched()
    if not parts:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionAll(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return hits.select("query_id", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def _search_block(index: DataFrame, block: list[tuple[int, np.ndarray]], n: int, mean: float, k: int, k1: float, b: float) -> DataFrame:
    """The k best documents of each shard for each query of the block."""
    spark = index.sparkSession
    terms = np.unique(np.concatenate([t for _, t in block]))
    sent = spark.sparkContext.broadcast((terms, block))  # about QUERY_TERMS numbers, and one query more

    def often(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value[0], None
        for batch in it:
            for i in range(batch.num_rows):
                x = _loaded(batch, i, ("terms", "first"))
                at = np.searchsorted(x["terms"], own)
                at[at == len(x["terms"])] = 0
                df = np.where(x["terms"][at] == own, np.diff(x["first"].astype(np.int64))[at], 0) if len(x["terms"]) else np.zeros(len(own), np.int64)
                total = df if total is None else total + df
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["at", "df"])

    got = mapped(index.select("terms", "first"), often, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()  # a row for each term of the block at most
    df = np.zeros(len(terms))
    df[got["at"].to_numpy(int)] = got["df"].to_numpy(float)
    weights = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = sent.value
        idf = weights.value
        places = [np.searchsorted(own, t) for _, t in asked]
        for batch in it:
            for i in range(batch.num_rows):
                x = _loaded(batch, i, tuple(c for c, _ in _COLUMNS))
                out = []
                for (q, t), p in zip(asked, places, strict=True):
                    d, s = _best(x, t, idf[p], mean, k, k1, b)
                    s, ids = np.round(s, _DIGITS), x["ids"][d]
                    top = np.lexsort((ids, -s))[:k]
                    out.append((np.full(len(top), q), ids[top], s[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out]), kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "doc_id", "score"])

    return mapped(index, best, "query_id long, doc_id long, score double")


def op2_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of benchmark as a query, against every row of documents."""
    return search(stored(build_index(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark"))


def op2_bm25_corpus_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents whose doc_id is divisible by 50 as a query with its whole text, against every row of documents, itself among them."""
    docs = table(spark, sf_dir, "documents")
    return search(stored(build_index(docs)), docs.filter("doc_id % 50 = 0"), id_col="doc_id")


ORACLE = rf"""
with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from low),
tf as (select doc_id, w, count(*) as tf from words group by doc_id, w),
len as (select low.doc_id, coalesce(sum(tf), 0) as dl from low left join tf using (doc_id) group by low.doc_id),
st as (select count(*) as n, avg(dl) as mean from len),
df as (select w, count(*) as df from tf group by w),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
s as (select item_id as query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / mean))), {_DIGITS}) as score
  from q join df using (w) join tf using (w) join len using (doc_id), st group by item_id, doc_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, doc_id))::int as rank, doc_id, score from s)
select * from r where rank <= {TOP}"""

#: The same with the rows of documents whose doc_id is divisible by 50 as queries.
CORPUS_ORACLE = ORACLE.replace("from benchmark)", "from (select doc_id as item_id, text from documents where doc_id % 50 = 0))")
