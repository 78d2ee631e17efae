"""Shared plumbing of the corpus operators: reading tables, cutting lineage, batches of bytes, hashing words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.staging import folder

#: Text bytes that one numpy pass works on; a worker's memory is a small multiple of it, since longer texts are taken in stretches.
PASS_BYTES = 1 << 18
#: Bytes of an Arrow batch, unless the session sets them: both sides hold whole batches.
ARROW_BYTES = 2 << 20
_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow(f, schema) with Arrow batches of about ARROW_BYTES, unless the session has a number of its own."""
    conf = df.sparkSession.conf
    if _BYTES_CONF not in conf.getAll:
        conf.set(_BYTES_CONF, ARROW_BYTES)
    return df.mapInArrow(f, schema)


#: Paths of the tables that written() has left, by application.
_made: dict[str, list[str]] = {}


def _paths(spark: SparkSession) -> list[str]:
    return _made.setdefault(spark.sparkContext.applicationId, [])


def made(spark: SparkSession) -> int:
    """How many tables written() has left."""
    return len(_paths(spark))


def cleared(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the tables that written() has left, without the first `since` and `but`, once no result of an operator reads them any more."""
    left, kept = _paths(spark), getattr(but, "_lodestone_path", None)
    for path in left[since:]:
        if path != kept:
            _delete(spark, path)
    left[since:] = [p for p in left[since:] if p == kept]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: short lineage that outlives any executor.

    group_rows: rows of a row group, at most. Writers look at the size of one only after 100 rows, and they and readers hold a whole one, so rows of megabytes need it.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    _paths(spark).append(path)
    return out


def dropped(*dfs: DataFrame | None) -> None:
    """Delete the tables of earlier written(); only once nothing lazy reads them any more."""
    for df in dfs:
        path = getattr(df, "_lodestone_path", None)
        if path in _paths(df.sparkSession) if path else False:
            _delete(df.sparkSession, path)
            _paths(df.sparkSession).remove(path)


def with_key(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """df with a long column that differs in every row, and that column's name: the id itself where every row has its own, which costs a count of ids, else a
    number, written down with the rows so that it stays the same."""
    key = "_key"
    while key in df.columns:
        key += "_"
    if df.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).count():
        return written(df.withColumn(key, F.monotonically_increasing_id()), "keyed"), key
    return df.withColumn(key, F.col(id_col).cast("long")), key


#: Bits of a filter that is broadcast, at most: a million words of 64.
FILTER_BITS = 1 << 26


def among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose column has a value that keys (a written table) has too, and few others: for use before an exact join, so that most rows that find nothing there are not shuffled.

    A bit for each key's hash is broadcast, 8 to 16 bits a key and FILTER_BITS at most; with more keys than that more rows stay, and none is lost.
    """
    bits = min(FILTER_BITS, 1 << max(6, (8 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), {bits}L) % 64 as int))")
    words = keys.select(F.shiftright(at, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumns({"_word": F.shiftright(at, 6), "_bit": bit}).join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns)


def one_row_per_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that share a key become one, which has their largest value (null is the smallest); costs a shuffle only if keys repeat."""
    repeats = df.groupBy(key).count().filter("count > 1").limit(1).count()
    return df.groupBy(key).agg(F.max(value).alias(value)) if repeats else df


def batches(it: Iterator[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's texts of each are of about `most` bytes (by default PASS_BYTES); a longer text makes its own batch."""
    most = most or PASS_BYTES
    for batch in it:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values: sums of value * base**i modulo 2**64, scaled back to exponent 0."""

    def __init__(self, base: int):
        self.base, self.back = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n or len(self.up) > max(8 * n, 8 * PASS_BYTES):  # tables that a long word has made go again
            self.up, self.down = _powers(self.base, n + 1024), _powers(self.back, n + 1024)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:], dtype=np.uint64)
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.down[starts])


_rng = np.random.default_rng(20240607)
_BYTES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_WORDS = [Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of a word [0-9A-Za-z\x80-\xFF]+.
NO_LETTERS = np.ones(256, bool)
NO_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of the texts of a batch, with 64-bit hashes: runs of bytes that aren't gaps, by default [^\\x20\\x09-\\x0D]+.

    starts, ends: byte places in data; doc: index of each word's text; first: index of the first word of each text, and one past the last.
    """

    def __init__(self, column: pa.Array, lower: bool = False, second: bool = False, gaps: np.ndarray = _SPACE):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        base, stop = int(offsets[0]), int(offsets[-1])
        whole = column.buffers()[2]
        raw = np.frombuffer(whole, np.uint8, stop - base, base) if stop > base else np.empty(0, np.uint8)
        offsets = offsets - base
        self.data = _LOWER[raw] if lower else raw
        space = gaps[self.data]
        new = ~space
        new[1:] &= space[:-1]
        inner = offsets[:-1]
        inner = inner[inner < len(space)]
        new[inner] = ~space[inner]
        self.starts = np.flatnonzero(new)
        last = ~space
        last[:-1] &= space[1:]
        tails = offsets[1:]
        tails = tails[tails > 0] - 1
        last[tails] = ~space[tails]
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.hashes = self._hash(0)
        self.hashes2 = self._hash(1) if second else None

    def _hash(self, k: int) -> np.ndarray:
        roll = _WORDS[k]
        return roll.spans(roll.sums(_BYTES[k][self.data]), self.starts, self.ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each run, one after the other; sizes are 1 at least."""
    if not len(sizes):
        return np.empty(0, np.int64)
    out = np.ones(int(sizes.sum()), np.int64)
    out[0] = starts[0]
    out[np.cumsum(sizes)[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def long_text(column: pa.Array) -> bytes | None:
    """The text of a column of one, if it is longer than a pass by far."""
    if len(column) != 1 or not column[0].is_valid:
        return None
    text = column.cast(pa.large_binary())[0].as_buffer()
    return text.to_pybytes() if text.size > 2 * PASS_BYTES else None


def cut_text(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PASS_BYTES that end between words."""
    at = 0
    while at < len(text) or not at:
        gap = _GAP.search(text, at + PASS_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        if not gap:
            return
        at = end


def stretches(text: bytes, back: int = 0, **how) -> Iterator[tuple[Words, int, bytes]]:
    """A long text's words, a stretch of about PASS_BYTES at a time, with the stretch itself. Each stretch but the first begins with the last `back` words of the one before;
    the number that comes with it tells how many of its words did. Only a single word that is longer makes a longer stretch."""
    at = end = again = 0
    while True:
        gap = _GAP.search(text, max(at + PASS_BYTES, end + 1))
        end = gap.start() if gap else len(text)
        piece = text[at:end]
        words = Words(pa.array([piece], pa.large_binary()), **how)
        yield words, again, piece
        if not gap:
            return
        again = min(back, len(words.starts))
        at = at + int(words.starts[len(words.starts) - again]) if again else end
