"""Near-dedup of embeddings by sorted projection passes.

Vectors of a label that are equal at length 1 are one first, with their number, so that windows span distinct vectors however often each is there.
In each pass every vector gets a key of concatenated random hashes, the signs of its projections; the vectors are ordered by label and key, and
each is compared with the next ones of its label within a window. Pairs whose cosine reaches the threshold are united over all passes. Links are
then counted within each component, block against block, so that windows bound what is compared to find components but lose no link in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, mapped, table, written
from lodestone.llm.graph import components, forest

THRESHOLD, PASSES, NEIGHBOURS = 0.98, 8, 128
#: Rows of a block when links are counted; vectors that one task sorts, about.
BLOCK, SORTED = 2048, 20_000
_BITS = 63


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.empty((0, 1))
    return x


def usable(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v, label) with dims, unit, h1 and h2: the vector at length 1, as bytes of doubles, and a hash of it and its label in 128 bits; null where it can have no links. Lists
    are read as flat arrays."""

    def norm(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, lists = batch.num_rows, batch["v"]
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            at = np.cumsum(size) - size
            count = lambda x: np.concatenate(([0], np.cumsum(x)))
            odd, some = count(~np.isfinite(flat)), count(flat != 0)
            good = (size > 0) & (odd[at + size] == odd[at]) & (some[at + size] > some[at]) & ~np.asarray(pc.is_null(batch["label"])) & ~np.asarray(pc.is_null(batch["vec_id"]))
            unit: list[bytes | None] = [None] * n
            for d in np.unique(size[good]).tolist():
                those = np.flatnonzero(good & (size == d))
                x = flat[at[those][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True) + 0.0  # no negative zeros, so that equal vectors have equal bytes
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                for i, row in zip(those.tolist(), x, strict=True):
                    unit[i] = row.tobytes()
            told = [hashlib.blake2b(len(u).to_bytes(8) + u + t.encode(), digest_size=16).digest() if u else bytes(16) for u, t in zip(unit, batch["label"].to_pylist(), strict=True)]
            whole = np.frombuffer(b"".join(told), np.int64).reshape(n, 2)
            mask = ~good
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(size, pa.int32(), mask=mask), pa.array(unit, pa.binary()), *(pa.array(whole[:, k], pa.int64(), mask=mask) for k in (0, 1))], ["vec_id", "label", "dims", "unit", "h1", "h2"])

    return mapped(rows, norm, "vec_id long, label string, dims int, unit binary, h1 long, h2 long")


def _keys(passes: int):
    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in it:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                if d not in planes:
                    planes[d] = np.random.default_rng(1009 + d).standard_normal((d, passes * _BITS))
                bits = (_unit(part["unit"].to_pylist()) @ planes[d] > 0).reshape(part.num_rows, passes, _BITS)
                keys = bits @ (1 << np.arange(_BITS, dtype=np.int64)[::-1])
                for k in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, k), pa.int32()), pa.array(keys[:, k]), *(part[c] for c in ("vec_id", "label", "dims", "unit"))], ["pass", "key", "vec_id", "label", "dims", "unit"])

    return keyed


def _near(unit: np.ndarray, group: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most window apart, of one group, with a cosine of the threshold or more."""
    found_a, found_b = [], []
    for at in range(0, len(unit), 256):
        to, reach = min(at + 256, len(unit)), min(at + 256 + window, len(unit))
        a, b = np.nonzero(unit[at:to] @ unit[at:reach].T >= threshold)
        a, b = a + at, b + at
        keep = (b > a) & (b - a <= window) & (group[a] == group[b])
        found_a.append(a[keep])
        found_b.append(b[keep])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, int), np.empty(0, int))


def _linked(ids: np.ndarray, unit: list[bytes], group: np.ndarray, window: int, threshold: float) -> list[tuple[int, int]]:
    """Edges that join what the window's pairs join, at most one for each row."""
    edges = []
    sizes = np.array([len(u) for u in unit])
    for s in np.unique(sizes):
        at = np.flatnonzero(sizes == s)
        a, b = _near(_unit([unit[i] for i in at]), group[at], window, threshold)
        root = forest(a, b, len(at))
        moved = np.flatnonzero(root != np.arange(len(at)))
        edges += zip(ids[at[moved]].tolist(), ids[at[root[moved]]].tolist(), strict=True)
    return edges


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("pass", pa.int32()), ("vec_id", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("unit", pa.binary())])


def window_edges(found: DataFrame, rows: int, passes: int = PASSES, window: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b) that join the linked vectors of found, a written table with so many rows, in windows of each pass."""

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in it:
            t = pa.Table.from_batches([batch])
            if held < window:  # the first rows also meet the last ones of the part before
                head = t.slice(0, window - held)
                held += head.num_rows
                yield _border(head, part - 1)
            t = pa.concat_tables([last, t]) if last is not None else t
            group = pc.binary_join_element_wise(pc.cast(t["pass"], pa.string()), pc.cast(t["dims"], pa.string()), t["label"], "/").combine_chunks().dictionary_encode().indices.to_numpy()
            edges = _linked(t["vec_id"].to_numpy(), t["unit"].to_pylist(), group, window, threshold)
            yield _edges(edges)
            last = t.slice(max(0, t.num_rows - window))
        if last is not None:
            yield _border(last, part)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, g in pdf.groupby(["pass", "dims", "label"], sort=False):
            g = g.drop_duplicates("vec_id")
            edges += _linked(g["vec_id"].to_numpy(), g["unit"].tolist(), np.zeros(len(g), int), 2 * window, threshold)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    parts = max(1, -(-rows * passes // SORTED))
    keyed = mapped(found, _keys(passes), "pass int, key long, vec_id long, label string, dims int, unit binary")
    order = ["pass", "label", "dims", "key", "vec_id"]
    walked = written(mapped(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order), walk, "a long, b long, part int, pass int, vec_id long, label string, dims int, unit binary"), "passes")
    inside = walked.filter("a is not null").select("a", "b")
    if parts == 1:
        return inside
    across = walked.filter("a is null and part >= 0").groupBy("part").applyInPandas(meet, "a long, b long")
    return inside.unionAll(across)


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    n = len(edges)
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64()), *(pa.nulls(n, f.type) for f in list(_EDGE)[2:])], schema=_EDGE)


def _border(t: pa.Table, part: int) -> pa.RecordBatch:
    n = t.num_rows
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, part), pa.int32()), *(t[f.name].combine_chunks() for f in list(_EDGE)[3:])], schema=_EDGE)


def link_counts(members: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links) of members (vec_id, component, unit, copies): links of one of the copies to its other copies and to others of the component.

    A component is dealt into blocks of about `block` vectors and each pair of blocks is compared by itself, so no task holds more than two blocks of one.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    dealt = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    # small components share a task, by a hash that keeps groups near the size of a block
    cells = dealt.withColumn("cell", F.xxhash64("component", "low", "high"))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, low, high), g in pdf.groupby(["component", "low", "high"], sort=False):
            own = g["own"].to_numpy()
            ids, copies, unit = g["vec_id"].to_numpy(), g["copies"].to_numpy(), _unit(g["unit"].tolist())
            a, b = (np.arange(len(g)), np.arange(len(g))) if low == high else (np.flatnonzero(own == low), np.flatnonzero(own == high))
            near = unit[a] @ unit[b].T >= threshold
            if low == high:
                np.fill_diagonal(near, True)
                out.append((ids, near @ copies - 1))
            else:
                out += [(ids[a], near @ copies[b]), (ids[b], copies[a] @ near)]
        return pd.DataFrame({"vec_id": np.concatenate([o[0] for o in out]), "n": np.concatenate([o[1] for o in out]).astype(np.int64)})

    total = members.count()
    small = cells.filter("blocks = 1").withColumn("cell", F.pmod("cell", F.lit(max(1, total // (4 * block)))))
    both = small.unionAll(cells.filter("blocks > 1"))
    return both.select("vec_id", "component", "own", "low", "high", "unit", "copies", "cell").groupBy("cell").applyInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors are linked if their labels are equal and their cosine, in doubles, is at least the threshold, and they came within a window
    in some pass, or are joined through others that did. Vectors that are null, zero, or hold nulls or non-finite components, and those without label or id, link with nothing, as do
    vectors of different lengths. Every row is a vector of its own, also where ids are null or repeat: component_id is the smallest id that links reach, null for a null id, which is kept.
    An empty table gives no rows; vectors of any length are read whole; other columns are ignored, whatever their names.
    """
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    found = written(usable(own), "vectors")
    # equal vectors of a label are one class, with a number of its own
    classes = found.filter("unit is not null").groupBy("h1", "h2", "label", "dims", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("vec_id"), "*"), "classes")
    n = classes.count()
    comps = written(components(window_edges(classes.select("vec_id", "label", "dims", "unit"), n, passes, window, threshold)).withColumnRenamed("id", "vec_id"), "components")
    counts = link_counts(classes.select("vec_id", "unit", "copies").join(comps, "vec_id"), threshold)
    joined = classes.select("vec_id", "h1", "h2", "least", "copies").join(comps, "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    least = written(joined.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    each = written(joined.join(least, "component").join(counts, "vec_id", "left").select("h1", "h2", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), "component_id"), "links")
    dropped(classes, comps, least)
    same = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", "h1", "h2").join(each, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), same.alias("component_id"), F.coalesce(same == F.col("vec_id"), F.lit(True)).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
