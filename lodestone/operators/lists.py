"""Exact dense top-k over clustered lists of vectors.

Every vector lies in the list of its nearest centre, and a list knows its radius, so no dot product with a query q in it exceeds q.centre + |q| * radius. A query looks into the lists with the highest bounds until they
hold k vectors, and then only into those whose bound reaches the k-th best score so far. Lists are scored in parts, blocks of queries against blocks of vectors as matrices; which lists are probed is all that is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.common import fits
from lodestone.operators.retrieval import DIGITS, top_hits

#: Centres are fitted on so many vectors, drawn by a hash of their ids; there are so many lists at most. Lists and their radii cover every vector.
SAMPLE, MOST_LISTS, STEPS = 20_000, 1024, 8
#: Vectors of a part of a list, and queries of a block.
PART, BLOCK = 512, 64
#: Lists whose centres a search may send to the tasks.
SENT_LISTS = 20_000


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the nearest of centres c for each row of x, a thousand rows at a time."""
    half = 0.5 * (c**2).sum(axis=1)
    return np.concatenate([(x[at : at + 1024] @ c.T - half).argmax(axis=1) for at in range(0, len(x), 1024)] or [np.empty(0, np.int64)])


def drawn(vectors: DataFrame, n: int, seed: int = 7) -> list:
    """About SAMPLE of n rows (doc_id, vector), the same whatever the layout: those whose hash falls in that share of all hashes. Each task sends its part of the sample alone; an order by the hash with a limit would send SAMPLE rows from every
    task and sort them in the driver."""
    at = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    rows = vectors.select(at.alias("_at"), "doc_id", "vector").filter(F.col("_at") < F.lit(-(-(SAMPLE << 40) // max(n, 1)))).limit(2 * SAMPLE).collect()
    return sorted(rows, key=lambda r: (r["_at"], r["doc_id"]))[:SAMPLE] or vectors.limit(1).collect()  # none of many only where all share few ids


def centres(vectors: DataFrame, seed: int = 7) -> np.ndarray:
    """Centres of (doc_id, vector), about the square root of their number; without vectors none."""
    n = vectors.count()
    some = drawn(vectors, n, seed)  # SAMPLE vectors
    if not some:
        return np.empty((0, 0))
    x = np.array([r["vector"] for r in some], np.float64)
    k = min(MOST_LISTS, max(1, round(n**0.5)), len(x))
    out = x[:k].copy()
    for _ in range(STEPS):
        own = _nearest(x, out)
        n_own = np.bincount(own, minlength=k)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out[n_own > 0] = sums[n_own > 0] / n_own[n_own > 0, None]
    return out


def build(vectors: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(list, centre, radius, n) and (doc_id, vector, list, part, ...) of vectors (doc_id, vector, ...), which are of one length; null, empty or incomplete ones are in no list."""
    good = vectors.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v)))
    found = centres(good, seed)
    spark = vectors.sparkSession
    if not len(found):
        return spark.createDataFrame([], "list int, centre array<double>, radius double, n long"), good.select("*", F.lit(0).alias("list"), F.lit(0).alias("part"))
    sent = spark.sparkContext.broadcast(found)  # MOST_LISTS rows

    @F.pandas_udf("list int, far double")
    def nearest(column: pd.Series) -> pd.DataFrame:
        c = sent.value
        x = np.array(column.tolist(), np.float64).reshape(-1, c.shape[1])
        own = _nearest(x, c)
        return pd.DataFrame({"list": own.astype(np.int32), "far": np.sqrt(((x - c[own]) ** 2).sum(axis=1))})

    placed = good.withColumn("_at", nearest("vector")).withColumns({"list": F.col("_at.list"), "_far": F.col("_at.far")}).drop("_at")
    sizes = placed.groupBy("list").agg((F.max("_far") * (1 + 1e-9) + 1e-9).alias("radius"), F.count("*").alias("n"))
    named = spark.createDataFrame([(i, c) for i, c in enumerate(found.tolist())], "list int, centre array<double>")
    lists = F.broadcast(named).join(sizes, "list").select("list", "centre", "radius", "n")
    parts = placed.join(F.broadcast(sizes.select("list", "n")), "list").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / PART)).cast("int"))  # MOST_LISTS rows
    return lists, parts.drop("_far", "n")


def probes(queries: DataFrame, lists: DataFrame, k: int, first: bool) -> DataFrame:
    """(query_id, vector, segment, list) of what queries (query_id, vector[, theta]) look into: first, the lists with the highest bounds that hold k vectors; else all others whose bound reaches theta, or simply
    all others where theta is null. lists: (segment, list, centre, radius, n), SENT_LISTS at most."""
    if not fits(lists, SENT_LISTS):
        raise ValueError(f"more than {SENT_LISTS} lists; merge the segments")
    rows = lists.select("segment", "list", "centre", "radius", "n").collect()
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast((np.array([r["centre"] for r in rows], np.float64), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows], np.int64), np.array([[r["segment"], r["list"]] for r in rows], np.int32).reshape(-1, 2)))

    def chosen(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, radius, n, names = sent.value
        for pdf in it:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                q = np.array(some["vector"].tolist(), np.float64)
                bound = q @ c.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1) - n[order]
                take = held < k  # the prefix that holds k
                if not first:
                    theta = some["theta"].astype(float).fillna(-np.inf).to_numpy()[:, None]
                    take = ~take & (np.take_along_axis(bound, order, 1) >= theta - 10.0**-DIGITS * 2 - 1e-9 * np.abs(theta, where=np.isfinite(theta), out=np.zeros_like(theta)))
                i, j = np.nonzero(take)
                own = names[order[i, j]]
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[i], "vector": some["vector"].to_numpy()[i], "segment": own[:, 0], "list": own[:, 1]})

    kind = dict(queries.dtypes)["query_id"]
    return queries.mapInPandas(chosen, f"query_id {kind}, vector array<double>, segment int, list int") if rows else spark.createDataFrame([], f"query_id {kind}, vector array<double>, segment int, list int")


def scored(asked: DataFrame, vectors: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(query_id, doc_id, score): of each part of a list the k best for each query that looks into it. asked: probes(); vectors: (segment, list, part, doc_id, vector)."""
    kinds = dict(asked.dtypes)["query_id"], dict(vectors.dtypes)["doc_id"]
    blocks = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(-(-max(n_queries, 1) // BLOCK)))).groupBy("segment", "list", "_block").agg(F.collect_list("query_id").alias("q"), F.collect_list("vector").alias("qv"))
    parts = vectors.groupBy("segment", "list", "part").agg(F.collect_list("doc_id").alias("d"), F.collect_list(F.col("vector").cast("array<double>")).alias("dv"))
    # as shuffled bytes a query's vector in many lists is small, as rows it is not: neither side may be broadcast by its size in the shuffle
    both = blocks.hint("merge").join(parts.hint("merge"), ["segment", "list"]).select("q", "qv", "d", "dv")

    def matrix(rows: pa.Scalar) -> np.ndarray:
        flat = rows.values
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                q, d = batch["q"][i].values, batch["d"][i].values
                s = np.round(matrix(batch["qv"][i]) @ matrix(batch["dv"][i]).T, DIGITS)
                least = np.sort(s, axis=1)[:, -min(k, s.shape[1])][:, None]
                a, b = np.nonzero(s >= least)  # ties stay; the last step ranks
                yield pa.RecordBatch.from_arrays([q.take(pa.array(a)), d.take(pa.array(b)), pa.array(s[a, b])], ["query_id", "doc_id", "score"])

    return both.mapInArrow(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def search(queries: DataFrame, lists: DataFrame, vectors: DataFrame, k: int, keep) -> DataFrame:
    """What retrieval.top_hits(dense(...), k) gives for queries (query_id, vector). keep: writes a table down and reads it again.

    lists: (segment, list, centre, radius, n); vectors: (segment, list, part, doc_id, vector), of which rows may be left out, such as those of other sources. Queries without a vector have no result.
    """
    asked = keep(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null"))
    n = asked.count()
    one = keep(scored(probes(asked, lists, k, True), vectors, k, n))
    last = top_hits(one, k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("theta"))
    two = scored(probes(asked.join(last, "query_id", "left"), lists, k, False), vectors, k, n)
    return top_hits(one.unionAll(two), k)


def probed(queries: DataFrame, lists: DataFrame, k: int, thetas: DataFrame) -> int:
    """How many (query, list) pairs search() looks into, given each query's (query_id, theta)."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    return probes(asked, lists, k, True).count() + probes(asked.join(thetas, "query_id", "left"), lists, k, False).count()
