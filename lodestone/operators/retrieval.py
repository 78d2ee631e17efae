"""Lexical and dense retrieval, rank fusion, reranking, exclusion and neighbour expansion, each for a batch of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.config import DEFAULTS, Settings
from lodestone.functions import text as T
from lodestone.operators.common import fits, ranked, small, top

DIGITS = 6


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index (doc_id, term, tf, dl); summed in place where a document's rows lie together."""
    words = docs.select(F.col(id_col).alias("doc_id"), T.token_list(text_col).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def _asked(queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(query_id, term) of each query's distinct terms, and what is done to a side of as many rows at most: a broadcast hint where they are few. Only the queries are counted."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(T.token_list(query_text))).alias("term"))
    return asked, F.broadcast if fits(asked) else lambda df: df


def _weights(index: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, mean_dl, idf) of the terms of index; stats: one row, n and mean_dl. tf is asked for so that the index is aggregated the same way as where it is summed."""
    return index.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df")).crossJoin(F.broadcast(stats)).select("term", "mean_dl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _impact(settings: Settings) -> Column:
    k1, b = settings.bm25_k1, settings.bm25_b
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean_dl")))


def _summed(index: DataFrame, weighted: DataFrame, settings: Settings) -> DataFrame:
    return index.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(_impact(settings)), DIGITS).alias("score"))


def bm25(queries: DataFrame, docs: DataFrame, settings: Settings = DEFAULTS, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", sources: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score): BM25 of each query's distinct terms; only pairs that share a term.

    The query side is broadcast where it is small, so that postings are cut to the terms asked for before anything is shuffled. sources: documents of others
    are not scored, but count in the statistics.
    """
    return _summed(*_matched(queries, docs, id_col, text_col, query_id, query_text, sources), settings)


def bm25_sweep(queries: DataFrame, docs: DataFrame, configs: dict[str, Settings], id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", sources: list[str] | None = None) -> DataFrame:
    """(config, query_id, doc_id, score): bm25() for each of the named settings, from one scan, one join and one aggregate, which has a sum for each."""
    index, weighted = _matched(queries, docs, id_col, text_col, query_id, query_text, sources)
    sums = [F.struct(F.lit(name).alias("config"), F.round(F.sum(_impact(s)), DIGITS).alias("score")) for name, s in configs.items()]
    every = index.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.array(*sums).alias("sums"))
    return every.select("query_id", "doc_id", F.explode("sums").alias("s")).select("s.config", "query_id", "doc_id", "s.score")


def _matched(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, sources: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Postings (doc_id, term, dl, tf) of the asked terms, and (query_id, term, mean_dl, idf)."""
    asked, near = _asked(queries, query_id, query_text)
    whole = docs.sparkSession.createDataFrame([("",)], "term string")  # no token is empty: a row for each document, which counts them
    terms = near(asked.select("term").distinct().unionAll(whole))
    shown = {"shown": F.coalesce(F.col("source").isin(sources), F.lit(False))} if sources else {}
    words = docs.select(F.col(id_col).alias("doc_id"), T.token_list(text_col).alias("w"), *(c.alias(n) for n, c in shown.items()))
    rows = words.select("doc_id", *shown, F.size("w").cast("long").alias("dl"), F.explode_outer(F.concat("w", F.array(F.lit("")))).alias("term"))
    # all statistics come from this one aggregate without further filters, so that its exchange is made once
    index = rows.join(terms, "term", "left_semi").groupBy("doc_id", "term", "dl", *shown).agg(F.count("*").alias("tf"))
    own = (F.col("term") == "") & (F.col("tf") > 0)
    stats = index.agg(F.count(F.when(own, 1)).alias("n"), F.avg(F.when(own, F.col("dl"))).alias("mean_dl"))
    return (index.filter("shown") if sources else index), near(asked.join(_weights(index, stats), "term"))


def bm25_stored(queries: DataFrame, postings: DataFrame, stats: DataFrame, settings: Settings = DEFAULTS, query_id: str = "query_id", query_text: str = "query", sources: list[str] | None = None) -> DataFrame:
    """What bm25() gives, from a stored index: postings (doc_id, term, tf, dl, source) and stats, one row, n and mean_dl. No text is read."""
    asked, near = _asked(queries, query_id, query_text)
    mine = postings.join(near(asked.select("term").distinct()), "term", "left_semi")
    shown = mine.filter(F.col("source").isin(sources)) if sources else mine
    # an index lies by term, so sums where it lies would leave nearly a row for each posting and query to shuffle; brought together by document first, only postings are shuffled
    return _summed(shown.repartition("doc_id"), near(asked.join(_weights(mine, stats), "term")), settings)


#: Postings of a stored index that a task gathers, at least, before it hands on their lists; rows of these lists that leave it at once.
LISTED, LIST_ROWS = 1 << 20, 10_000
#: The columns of such lists.
LISTS = ("doc_id", "tf", "dl", "source")


def listed(docs: DataFrame) -> DataFrame:
    """An inverted index of documents (doc_id, w: their tokens or null, source), made where they lie, so that no posting is shuffled: (term, doc_id, tf, dl, source), of which all but term are lists that belong together. A task
    gives lists for each run of documents with LISTED postings or a little more, and in a run terms ascend."""
    kind = dict(docs.dtypes)["doc_id"]
    values = {"doc_id": to_arrow_type(docs.schema["doc_id"].dataType), "tf": pa.int32(), "dl": pa.int32(), "source": pa.string()}

    def made(ids: list, sources: list, lengths: list, terms: list, doc: list, code: list, tf: list) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays(terms).dictionary_encode()
        order = pc.sort_indices(words.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        place = place[words.indices.to_numpy()]  # of each batch's terms, one batch after the other
        term = place[np.concatenate([c + at for c, at in zip(code, np.cumsum([0, *map(len, terms)]), strict=False)])]
        by = np.argsort(term, kind="stable")
        at = np.concatenate([d + n for d, n in zip(doc, np.cumsum([0, *map(len, lengths)]), strict=False)])[by]
        starts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(order))))), pa.int32())
        columns = (pa.concat_arrays(ids).take(pa.array(at)), pa.array(np.concatenate(tf)[by], pa.int32()), pa.array(np.concatenate(lengths)[at], pa.int32()), pa.concat_arrays(sources).take(pa.array(at)))
        every = pa.RecordBatch.from_arrays([words.dictionary.take(order), *(pa.ListArray.from_arrays(starts, c.cast(k)) for c, k in zip(columns, values.values(), strict=True))], ["term", *values])
        for first in range(0, every.num_rows, LIST_ROWS):
            yield every.slice(first, LIST_ROWS)

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in (whole.slice(at, BLOCK_DOCS) for whole in it for at in range(0, whole.num_rows, BLOCK_DOCS)):
            dl = pc.fill_null(pc.list_value_length(batch["w"]), 0).to_numpy().astype(np.int64)
            words = batch["w"].flatten().cast(pa.string()).dictionary_encode()
            if len(words):
                key, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
                held.append((batch["doc_id"], batch["source"].cast(pa.string()), dl, words.dictionary, key // len(words.dictionary), key % len(words.dictionary), tf))
                n += len(key)
            if n >= LISTED:
                yield from made(*map(list, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield from made(*map(list, zip(*held, strict=True)))

    return docs.select("doc_id", "w", "source").mapInArrow(build, f"term string, doc_id array<{kind}>, tf array<int>, dl array<int>, source array<string>")


def unlisted(lists: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl, source, ...): the postings of listed()."""
    others = [c for c in lists.columns if c not in LISTS]
    return lists.select(*others, F.inline(F.arrays_zip(*LISTS))).withColumns({"tf": F.col("tf").cast("long"), "dl": F.col("dl").cast("long")})


def by_document(lists: DataFrame) -> DataFrame:
    """(doc_id, segment, dl, source, p): a row for each document of listed() with a segment and code, a number, in place of term; p: code * 2**32 + tf of each of its terms. Lists are turned around where they lie, and only what a task
    has of a document is shuffled, as one row."""
    doc = lists.schema["doc_id"].dataType.elementType
    names, kinds = ["doc_id", "segment", "dl", "source", "p"], [to_arrow_type(doc), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())]

    def turned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size = pc.fill_null(pc.list_value_length(batch["doc_id"]), 0).to_numpy().astype(np.int64)
            if not size.sum():
                continue
            ids, segments = batch["doc_id"].flatten().dictionary_encode(), batch["segment"].dictionary_encode()
            key = ids.indices.to_numpy().astype(np.int64) * len(segments.dictionary) + np.repeat(segments.indices.to_numpy(), size)
            p = (np.repeat(batch["code"].to_numpy().astype(np.int64), size) << 32) + batch["tf"].flatten().to_numpy()
            found, first, times = np.unique(key, return_index=True, return_counts=True)
            starts, at = pa.array(np.concatenate(([0], np.cumsum(times))), pa.int32()), pa.array(first)
            columns = (ids.dictionary.take(pa.array(found // len(segments.dictionary))), segments.dictionary.take(pa.array(found % len(segments.dictionary))), batch["dl"].flatten().take(at), batch["source"].flatten().take(at), pa.ListArray.from_arrays(starts, pa.array(p[np.argsort(key, kind="stable")])))
            every = pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names)
            for n in range(0, every.num_rows, BLOCK_DOCS):
                yield every.slice(n, BLOCK_DOCS)

    rows = lists.select("segment", "code", *LISTS).mapInArrow(turned, f"doc_id {doc.simpleString()}, segment int, dl int, source string, p array<bigint>")
    return rows.groupBy("doc_id", "segment").agg(F.first("dl").alias("dl"), F.first("source").alias("source"), F.flatten(F.collect_list("p")).alias("p"))


def by_document_top(docs: DataFrame, asked: DataFrame, pairs: list, terms: list[str], n: int, mean: float, k: int, settings: Settings = DEFAULTS, sources: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of bm25_stored() for each query, from a written by_document(), whose codes are places in terms; each is scored where it lies, and a task keeps k of them for a query. pairs: asked, (query_id, term)."""
    counted = docs.select(F.explode("p").alias("p")).groupBy(F.shiftright("p", 32).alias("code")).count().collect()  # a row for each asked term
    own = _Asked(pairs, {terms[r["code"]]: r["count"] for r in counted}, n, mean, [settings])
    at = {t: i for i, t in enumerate(own.terms)}
    sent = docs.sparkSession.sparkContext.broadcast((own, np.array([at.get(t, -1) for t in terms], np.int64)))

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = sent.value
        best = _Best(k, len(own.ids))
        for batch in (whole.slice(first, BLOCK_DOCS) for whole in it for first in range(0, whole.num_rows, BLOCK_DOCS)):
            size = pc.list_value_length(batch["p"]).to_numpy().astype(np.int64)
            p, ids = batch["p"].flatten().to_numpy(), batch["doc_id"].to_numpy(zero_copy_only=False)
            for first, last, _, scores in own.blocks(np.repeat(np.arange(len(size)), size), place[p >> 32], p & 0xFFFFFFFF, batch["dl"].to_numpy().astype(np.int64)):
                best.add(scores, ids[first:last])
        yield from _kept([best], own.ids, schema)

    out, schema = _schemas(asked, dict(docs.dtypes)["doc_id"])
    shown = docs.filter(F.col("source").isin(sources)) if sources else docs
    return _named(shown.select("doc_id", "dl", "p").mapInArrow(found, out), {"": settings}, k).drop("config")


#: Scores that a task holds at once: documents of a block times queries, and postings of it times queries that ask for their terms.
BLOCK_SCORES = 1 << 22
#: Documents of an Arrow batch whose words a task looks up at once.
BLOCK_DOCS = 1000


class _Asked:
    """What a task needs to score documents: the terms asked for with their idf, which queries ask for each, and each setting's k1 and b. Sent to all tasks; no larger than what may be broadcast."""

    def __init__(self, pairs: list, df: dict[str, int], n: int, mean: float, settings: list[Settings]):
        self.ids = list(dict.fromkeys(r["query_id"] for r in pairs))
        at = {q: i for i, q in enumerate(self.ids)}
        self.terms = sorted({r["term"] for r in pairs} & df.keys())
        code = {t: i for i, t in enumerate(self.terms)}
        both = np.array([(code[r["term"]], at[r["query_id"]]) for r in pairs if r["term"] in code], np.int64).reshape(-1, 2)
        both = both[np.argsort(both[:, 0], kind="stable")]
        self.asking, self.times = both[:, 1], np.bincount(both[:, 0], minlength=len(self.terms))  # queries of each term, one after the other
        self.starts = np.cumsum(self.times) - self.times
        held = np.array([df[t] for t in self.terms], np.float64)
        self.idf, self.mean, self.settings = np.log(1 + (n - held + 0.5) / (held + 0.5)), mean or 1.0, [(s.bm25_k1, s.bm25_b) for s in settings]

    def blocks(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first document, one past the last, setting, scores of documents by queries) of postings in the order of their documents, which are numbered from 0; dl is of documents. No score: 0."""
        n, width = len(dl), max(len(self.ids), 1)
        work = np.concatenate(([0], np.cumsum(np.bincount(doc, self.times[term], minlength=n) + width)))
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(work, work[first] + BLOCK_SCORES, side="right")) - 1)
            a, b = np.searchsorted(doc, (first, last))
            d, t, f = doc[a:b] - first, term[a:b], tf[a:b]
            each = self.times[t]
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.starts[t], each)
            cell = np.repeat(d, each) * width + self.asking[at]
            for i, (k1, b_) in enumerate(self.settings):
                impact = self.idf[t] * f * (k1 + 1) / (f + k1 * (1 - b_ + b_ * dl[first:last][d] / self.mean))
                yield first, last, i, np.bincount(cell, np.repeat(impact, each), minlength=(last - first) * width).reshape(-1, width)
            first = last


class _Best:
    """The k best documents so far of each query, in one setting; ties go to the smaller id."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.least = k, np.full(n_queries, -1.0)
        self.query, self.doc, self.score = np.empty(0, np.int64), None, np.empty(0)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        s = np.where(scores > 0, np.floor(scores * 10**DIGITS + 0.5) / 10**DIGITS, -2.0)
        own = np.partition(s, -self.k, axis=0)[-self.k] if len(s) > self.k else np.full(s.shape[1], -1.0)
        d, q = np.nonzero(s >= np.maximum(np.maximum(own, self.least), 0.0))
        if not len(d):
            return
        query, score = np.concatenate((self.query, q)), np.concatenate((self.score, s[d, q]))
        doc = docs[d] if self.doc is None else np.concatenate((self.doc, docs[d]))
        order = np.lexsort((np.unique(doc, return_inverse=True)[1], -score, query))
        query, score, doc = query[order], score[order], doc[order]
        starts = np.searchsorted(query, np.arange(len(self.least)))
        place = np.arange(len(query)) - starts[query]
        full = place == self.k - 1
        self.least[query[full]] = score[full]
        keep = place < self.k
        self.query, self.score, self.doc = query[keep], score[keep], doc[keep]


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, settings: Settings = DEFAULTS, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", sources: list[str] | None = None) -> DataFrame:
    """What top_hits(bm25(...), k) gives: (query_id, doc_id, score, rank)."""
    return bm25_sweep_top(queries, docs, {"": settings}, k, id_col, text_col, query_id, query_text, sources).drop("config")


def bm25_sweep_top(queries: DataFrame, docs: DataFrame, configs: dict[str, Settings], k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", sources: list[str] | None = None) -> DataFrame:
    """(config, query_id, doc_id, score, rank): the k best of bm25_sweep() for each query in each of the settings.

    Every document is scored where it lies, and a task keeps k of them for a query, so that neither postings nor pairs reach a shuffle or a hash table. The documents are read twice: the statistics come first, a row for each term that is asked
    for. Where the queries are too many to be sent to the tasks, or ids repeat, so that a document lies in several rows, it is a join.
    """
    asked, pairs = asked_pairs(queries, query_id, query_text)
    kind = dict(docs.dtypes)[id_col]
    if not pairs or kind not in ("string", "bigint", "int") or docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count():
        every = bm25_sweep(queries, docs, configs, id_col, text_col, query_id, query_text, sources)
        return top(every, ["config", "query_id"], [F.col("score").desc(), "doc_id"], k)
    words = T.token_list(text_col)
    terms = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in {"", *(r["term"] for r in pairs)}], "term string"))  # what asked_pairs() measured
    # no token is empty: a row for each document, which counts them; outer, since else a filter is inferred that splits texts once more
    rows = docs.select(words.alias("w")).select(F.size("w").cast("long").alias("dl"), F.explode_outer(F.array_distinct(F.concat("w", F.array(F.lit(""))))).alias("term"))
    counted = rows.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")).collect()
    df = {r["term"]: r["df"] for r in counted}
    n = df.pop("", 0)
    own = _Asked(pairs, df, n, sum(r["dl"] for r in counted if r["term"] == "") / max(n, 1), list(configs.values()))
    sent = docs.sparkSession.sparkContext.broadcast(own)
    shown = docs.filter(F.coalesce(F.col("source").isin(sources), F.lit(False))) if sources else docs
    size = BLOCK_DOCS

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known, best = pa.array(own.terms, pa.string()), [_Best(k, len(own.ids)) for _ in own.settings]
        for batch in (whole.slice(at, size) for whole in it for at in range(0, whole.num_rows, size)):
            dl = pc.fill_null(pc.list_value_length(batch["w"]), 0).to_numpy().astype(np.int64)
            code = pc.fill_null(pc.index_in(batch["w"].flatten().cast(pa.string()), value_set=known), -1).to_numpy()
            doc = np.repeat(np.arange(len(dl)), dl)[code >= 0]
            key, tf = np.unique(doc * len(own.terms) + code[code >= 0], return_counts=True)
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for first, last, i, scores in own.blocks(key // max(len(own.terms), 1), key % max(len(own.terms), 1), tf, dl):
                best[i].add(scores, ids[first:last])
        yield from _kept(best, own.ids, schema)

    out, schema = _schemas(asked, kind)
    hits = shown.select(F.col(id_col).alias("doc_id"), words.alias("w")).mapInArrow(found, out)
    return _named(hits, configs, k)


def asked_pairs(queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, list]:
    """(query_id, term) as in _asked(), and its rows if they are few enough to be sent to the tasks, else none."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(T.token_list(query_text))).alias("term"))
    return asked, asked.collect() if fits(asked) else []


def _schemas(asked: DataFrame, kind: str) -> tuple[str, pa.Schema]:
    query = asked.schema["query_id"].dataType
    doc = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    return f"_at int, query_id {query.simpleString()}, doc_id {kind}, score double", pa.schema([("_at", pa.int32()), ("query_id", to_arrow_type(query)), ("doc_id", doc), ("score", pa.float64())])


def _kept(best: list[_Best], ids: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i, b in enumerate(best):
        if len(b.query):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.query), i, np.int32)), pa.array([ids[q] for q in b.query], schema.field("query_id").type), pa.array(b.doc, schema.field("doc_id").type), pa.array(b.score)], schema=schema)


def _named(hits: DataFrame, configs: dict[str, Settings], k: int) -> DataFrame:
    """Ranks over what the tasks kept."""
    names = F.element_at(F.array(*map(F.lit, configs)), F.col("_at") + 1).alias("config")
    return top(hits.select(names, "query_id", "doc_id", "score"), ["config", "query_id"], [F.col("score").desc(), "doc_id"], k)


def top_hits(scored: DataFrame, k: int) -> DataFrame:
    """The k best for each query; ties go to the smaller id."""
    return top(scored, ["query_id"], [F.col("score").desc(), "doc_id"], k)


def dense(queries: DataFrame, vectors: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score): dot products of queries (query_id, vector) with vectors (doc_id, vector[, source]); a source filter goes before scoring."""
    if sources:
        vectors = vectors.filter(F.col("source").isin(sources))
    asked = small(queries.select("query_id", F.col("vector").alias("q")), 10_000)
    return vectors.crossJoin(asked).select("query_id", "doc_id", F.round(T.dot("q", "vector"), DIGITS).alias("score"))


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """What top_hits(dense(...), k) gives. Up to `block` queries are broadcast as a matrix, and each Arrow batch of vectors keeps its k best of a query, so that pairs never reach a shuffle; more of them are joined, in
    blocks, with the clustered lists that may hold one of their k best, and none comes to the driver. Vectors are of one length."""
    asked = queries.select("query_id", "vector").filter("vector is not null")
    rows = vectors.select("doc_id", "vector").filter("vector is not null")
    if not fits(asked, block):
        from lodestone.operators import lists
        from lodestone.sources.staging import staged

        made, placed = (staged(t.withColumn("segment", F.lit(0))) for t in lists.build(rows))
        return lists.search(asked, made, placed, k, staged)
    held = asked.collect()  # at most `block` vectors
    if not held:
        return top_hits(dense(queries, vectors), k)
    sent = queries.sparkSession.sparkContext.broadcast(([r["query_id"] for r in held], np.array([r["vector"] for r in held], np.float64)))

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for pdf in it:
            doc = pdf["doc_id"].to_numpy()
            s = np.round(q @ np.array(pdf["vector"].tolist(), np.float64).T, DIGITS)
            order = np.stack([np.lexsort((doc, -row))[:k] for row in s])
            yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "doc_id": doc[order.ravel()], "score": np.take_along_axis(s, order, 1).ravel()})

    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["doc_id"]
    return top_hits(rows.mapInPandas(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"), k)


def rrf(lists: DataFrame, k: int = DEFAULTS.rrf_k, keep: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, first_list, first_rank, rank) of ranked rows (query_id, list_no, doc_id, rank): sums of 1 / (k + rank).

    Ties keep the order of first sight: list, then rank in it. A sum over the union of all lists stands for the full outer join.
    """
    seen = F.struct("list_no", "rank")
    fused = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(seen).alias("first"))
    fused = fused.select("query_id", "doc_id", "score", F.col("first.list_no").alias("first_list"), F.col("first.rank").alias("first_rank"))
    fused = ranked(fused, ["query_id"], [F.col("score").desc(), "first_list", "first_rank", "doc_id"])
    return fused.filter(F.col("rank") <= keep) if keep else fused


def hybrid(sparse: DataFrame, dense_hits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Both branches' best, fused; the order of first sight has dense hits first."""
    one = top_hits(dense_hits, settings.top_k_dense).select("query_id", F.lit(0).alias("list_no"), "doc_id", "rank")
    two = top_hits(sparse, settings.top_k_sparse).select("query_id", F.lit(1).alias("list_no"), "doc_id", "rank")
    return rrf(one.unionByName(two), settings.rrf_k, settings.top_k_fused)


def coverage(query: Column, text: Column) -> Column:
    """The stand-in for a reranking model: the share of the query's distinct tokens that the text has."""
    asked = T.token_set(query)
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, T.token_set(text))) / F.size(asked), DIGITS)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, settings: Settings = DEFAULTS, keep: int | None = None) -> DataFrame:
    """hits (query_id, doc_id, rank, rerank_score) whose score reaches the threshold, by score; ties keep the old rank. new_rank counts from 1."""
    good = hits.filter(F.col("rerank_score") >= settings.rerank_threshold)
    return top(good, ["query_id"], [F.col("rerank_score").desc(), "rank"], keep or settings.top_k_rerank, "new_rank")


def exclude(hits: DataFrame, rejected: DataFrame) -> DataFrame:
    """hits without the rejected (query_id, doc_id); ranks are counted anew within query and list."""
    left = hits.join(rejected.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    return ranked(left.withColumnRenamed("rank", "_old"), ["query_id", "list_no"], ["_old"]).drop("_old")


def fuse_queries(lists: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Seeds of a question from its queries' lists (query_id, list_no, doc_id, rank, rerank_score): fused, each with the best copy's rerank score; the first list wins a tie."""
    best = ranked(lists, ["query_id", "doc_id"], [F.col("rerank_score").desc(), "list_no"], "_at").filter("_at = 1").select("query_id", "doc_id", "rerank_score", F.col("list_no").alias("best_list"))
    return rrf(lists, settings.rrf_k, settings.top_k_rerank).join(best, ["query_id", "doc_id"])


def expand_neighbors(seeds: DataFrame, chunks: DataFrame, excluded: DataFrame | None = None, window: int = 1, max_total: int = 12, same_section: bool = True) -> DataFrame:
    """Seeds with nearby chunks of their documents: (query_id, chunk_id, position, is_neighbor, seed_chunk_id).

    seeds: (query_id, chunk_id, doc_id, chunk_index, section, rank). A nearby chunk is asked for by distance, then seed rank, then the one before first; it
    belongs to the first seed that asks, also where that seed's section differs and it is lost. Seeds are never cut. excluded: (query_id, chunk_id). The range
    join is an equality join on generated indexes.
    """
    sizes = seeds.groupBy("query_id").agg(F.count("*").alias("n_seeds"))
    own = seeds.select("query_id", "chunk_id", F.col("rank").cast("long").alias("position"), F.lit(False).alias("is_neighbor"), F.lit("").alias("seed_chunk_id"))
    if window <= 0:
        return own
    able = seeds.filter((F.coalesce("doc_id", F.lit("")) != "") & (F.col("chunk_index") >= 0)).join(sizes.filter(F.col("n_seeds") < max_total), "query_id")
    steps = F.explode(F.filter(F.sequence(F.lit(-window), F.lit(window)), lambda d: d != 0))
    asked = able.select("*", steps.alias("step")).withColumn("at", F.col("chunk_index") + F.col("step")).filter("at >= 0")
    asked = asked.select("query_id", "n_seeds", F.col("chunk_id").alias("seed_chunk_id"), F.col("section").alias("seed_section"), "rank", "step", T.chunk_id("doc_id", "at").alias("chunk_id"))
    seen = seeds.select("query_id", "chunk_id")
    if excluded is not None:
        seen = seen.unionByName(excluded.select("query_id", "chunk_id"))
    asked = asked.join(seen.distinct(), ["query_id", "chunk_id"], "left_anti")
    first = ranked(asked, ["query_id", "chunk_id"], [F.abs("step"), "rank", "step"], "_at").filter("_at = 1")
    found = first.join(chunks.select("chunk_id", "section"), "chunk_id")
    if same_section:
        found = found.filter(F.col("section").eqNullSafe(F.col("seed_section")))
    found = ranked(found, ["query_id"], [F.abs("step"), "rank", "step"], "_at").filter(F.col("_at") + F.col("n_seeds") <= max_total)
    near = found.select("query_id", "chunk_id", (F.col("n_seeds") + F.col("_at")).alias("position"), F.lit(True).alias("is_neighbor"), "seed_chunk_id")
    return own.unionByName(near)


def merge_evidence(existing: DataFrame, fresh: DataFrame, limit: int) -> DataFrame:
    """The working set (query_id, chunk_id, rerank_score, is_neighbor, position): one row for each chunk, a direct hit before a neighbour, then the better score, then the one that was there.

    Both sides: (query_id, chunk_id, rerank_score, is_neighbor, position). Sorted by neighbour, then score; ties keep the place of the chunk's first appearance.
    """
    both = existing.withColumn("fresh", F.lit(0)).unionByName(fresh.withColumn("fresh", F.lit(1)))
    place = F.min(F.struct("fresh", "position")).alias("place")
    first = both.groupBy("query_id", "chunk_id").agg(place)
    best = ranked(both, ["query_id", "chunk_id"], ["is_neighbor", F.col("rerank_score").desc(), "fresh", "position"], "_at").filter("_at = 1").drop("fresh", "position", "_at")
    return top(best.join(first, ["query_id", "chunk_id"]), ["query_id"], ["is_neighbor", F.col("rerank_score").desc(), "place"], limit, "position").drop("place")


def lookup(requests: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks asked for by requests (request_id, ids ARRAY), in the order of the request as `position` from 0; missing ids drop out."""
    asked = requests.select("request_id", F.posexplode("ids").alias("position", key))
    return asked.join(chunks, key)
