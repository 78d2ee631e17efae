"""Fingerprints of documents from improbable features: byte windows ranked by how rare their entropy is, in chained Bloom filters that are compared by normalised bit overlap.

A feature is a window of WINDOW bytes of the text, which half a window of zero bytes precedes and follows, so that short texts have features too. Its entropy, in thousandths of the largest, has a rank: the rarer in
the whole corpus, the better; entropies below LEAST_ENTROPY, which many texts share, come last. The best window of each SPAN successive ones, the first of equals, gets a point, and windows with LEAST_POINTS or more are selected. Which windows
are selected hangs on the text around them alone, so an edit changes the features near it and no others. A document's distinct features fill Bloom filters of BITS bits, HASHES each, in their order; a filter that
holds FEATURES is followed by the next. An empty or null text has none.

Likeness of two chains: for each filter of the one with fewer features the best overlap with a filter of the other, averaged by features. Overlap is the number of common bits between what chance gives (and CUT of the way up) and the most
that is possible, as 0 to 1. Equal chains have 1, two empty ones too; an empty and another have 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.common import _BYTES, Rolling, batches, mapped, runs, table

WINDOW, SPAN, LEAST_POINTS, LEAST_ENTROPY = 32, 64, 8, 250
BITS, FEATURES, HASHES, CUT = 2048, 160, 5, 0.15
_PAD, _GAP = bytes(WINDOW // 2), SPAN + WINDOW
_NEVER = np.int64(1 << 62)
_ROLL = Rolling(0xD6E8FEB86659FD93)
# What one more occurrence of a byte adds to the sum of n log2 n over a window's bytes, in units of 2**-20.
_n = np.arange(1, WINDOW + 1)
_MORE = np.append(0, np.round((_n * np.log2(_n) - np.append(0, _n[:-1] * np.log2(np.maximum(_n[:-1], 1)))) * (1 << 20))).astype(np.int64)
_SUMS = np.cumsum(_MORE)


def entropies(x: np.ndarray) -> np.ndarray:
    """Entropy of the window that begins at each place of x, in thousandths of the largest."""
    n = len(x) - WINDOW + 1
    after, before = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)  # times that a byte stands in the window that begins, or ends, with it
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    sums = np.empty(n, np.int64)
    sums[0] = _SUMS[np.bincount(x[:WINDOW])].sum()
    sums[1:] = _MORE[before[WINDOW:]] - _MORE[after[: n - 1]]
    np.cumsum(sums, out=sums)
    return (_SUMS[WINDOW] - sums) * 1000 // _SUMS[WINDOW]


def _selected(keys: np.ndarray) -> np.ndarray:
    """Places with LEAST_POINTS or more, a point for each SPAN successive keys of which theirs is the least."""
    size = -(-(len(keys) + 2 * SPAN) // SPAN) * SPAN
    padded = np.full(size, _NEVER)
    padded[SPAN - 1 : SPAN - 1 + len(keys)] = keys
    blocks = padded.reshape(-1, SPAN)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: size - SPAN + 1], left[SPAN - 1 :])
    points = np.bincount(least[least < _NEVER] & ((1 << 40) - 1), minlength=len(keys))
    return np.flatnonzero(points >= LEAST_POINTS)


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, with zeros around each, in one array; where each begins with its zeros; lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer(b"".join(p for t in texts for p in (_PAD, t, _PAD, bytes(_GAP))), np.uint8)
    return x, np.cumsum(lengths + WINDOW + _GAP) - (lengths + WINDOW + _GAP), lengths


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Stretches of the texts laid out: bytes, places where windows begin, the numbers of their texts, and from where to where a place counts for this stretch.
    A text that is longer than a pass by far is taken alone, in stretches with what their selection needs on both sides."""
    x, starts, lengths = _laid(texts)
    if len(texts) > 1 or len(x) <= 2 * common.PASS_BYTES:
        own = np.flatnonzero(lengths)
        size = lengths[own] + 1
        yield x, runs(starts[own], size), np.repeat(own, size), 0, len(x)
        return
    for a in range(0, int(lengths[0]) + 1, common.PASS_BYTES):
        low = max(0, a - SPAN)
        piece = x[low : a + common.PASS_BYTES + _GAP]
        places = np.arange(min(int(lengths[0]) + 1 - low, len(piece) - WINDOW + 1))
        yield piece, places, np.zeros(len(places), np.int64), a - low, a - low + common.PASS_BYTES


def rarities(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each entropy, 0 to 1000, over all texts of docs: the rarest has 0, of equally rare ones the largest; those below LEAST_ENTROPY come last, the largest of them first."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, np.int64)
        for batch in batches(it, "text"):
            for x, places, _, a, b in _pieces([(t or "").encode() for t in batch["text"].to_pylist()]):
                total += np.bincount(entropies(x)[places[(places >= a) & (places < b)]], minlength=1001)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1001), pa.int32()), pa.array(total)], ["entropy", "n"])

    found = mapped(docs.select(F.col(text_col).cast("string").alias("text")), counted, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect()  # 1001 rows
    n = np.zeros(1001, np.int64)
    for r in found:
        n[r["entropy"]] = r["n"]
    ranks = np.empty(1001, np.int64)
    low = np.arange(1001) < LEAST_ENTROPY
    ranks[np.lexsort((-np.arange(1001), np.where(low, 0, n), low))] = np.arange(1001)
    return ranks


Chain = tuple[np.ndarray, np.ndarray]  # features of each filter, and its bits, as a row of 64-bit numbers


def chains(texts: list[bytes], ranks: np.ndarray) -> list[Chain]:
    """The Bloom filters of each text."""
    found = []
    for x, places, owner, a, b in _pieces(texts):
        if not len(places):
            continue
        rank = ranks[entropies(x)[places]]
        keys = np.full(len(x), _NEVER)
        keys[places] = (rank << 40) | places
        at = _selected(keys)
        at = at[(at >= a) & (at < b)]
        sums = _ROLL.sums(_BYTES[0][x])
        found.append((owner[np.searchsorted(places, at)], _ROLL.spans(sums, at, at + WINDOW)))
    doc = np.concatenate([d for d, _ in found]) if found else np.empty(0, np.int64)
    feature = np.concatenate([f for _, f in found]) if found else np.empty(0, np.uint64)
    order = np.lexsort((np.arange(len(doc)), feature, doc))  # the first of equal features of a document
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (feature[order][1:] != feature[order][:-1])
    first = np.sort(order[new])
    first = first[np.argsort(doc[first], kind="stable")]
    doc, feature = doc[first], feature[first]
    size = np.bincount(doc, minlength=len(texts))
    filters = -(-size // FEATURES)
    row = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.cumsum(filters) - filters, size) + row // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), bool)
    bits[row[:, None], (feature[:, None] >> np.arange(0, 11 * HASHES, 11, dtype=np.uint64)).astype(np.int64) % BITS] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    counts = np.bincount(row, minlength=len(bits))
    ends = np.cumsum(filters)
    return [(counts[e - f : e], packed[e - f : e]) for e, f in zip(ends.tolist(), filters.tolist(), strict=True)]


def text_of(chain: Chain) -> str:
    """A chain as text: of each filter its number of features, as two bytes, and its bits, in base 64."""
    return base64.b64encode(b"".join(int(n).to_bytes(2, "little") + b.tobytes() for n, b in zip(*chain, strict=True))).decode()


def chain_of(text: str) -> Chain:
    """The chain that text_of() gave."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 2 + BITS // 8)
    return raw[:, :2].astype(np.int64) @ np.array([1, 256]), np.ascontiguousarray(raw[:, 2:]).view(np.uint64)


def likeness(one: Chain, other: Chain) -> float:
    """0 to 1, the same both ways, in six places."""
    if not len(one[0]) or not len(other[0]):
        return float(len(one[0]) == len(other[0]))
    if len(one[0]) == len(other[0]) and np.array_equal(one[1], other[1]):
        return 1.0
    one, other = sorted((one, other), key=lambda c: (int(c[0].sum()), c[1].tobytes()))
    there = np.bitwise_count(other[1]).sum(axis=1, dtype=np.int64)
    total = 0.0
    for n, bits in zip(*one, strict=True):
        own = int(np.bitwise_count(bits).sum())
        both = np.bitwise_count(bits & other[1]).sum(axis=1, dtype=np.int64)
        chance, most = own * there / BITS, np.minimum(own, there)
        cut = chance + CUT * (most - chance)
        total += int(n) * max(0.0, float(((both - cut) / (most - cut)).max()))
    return round(total / int(one[0].sum()), 6)


def _bucket(bounds: list[int]):
    """How many of the ascending bounds are not above the column id, by halving; -1 for null."""
    if not bounds:
        return F.when(F.col("id").isNull(), -1).otherwise(0)
    ordered = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(ordered, at + step - 1) <= F.col("id")), at + step).otherwise(at))
    return F.when(F.col("id").isNull(), -1).otherwise(found)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_task: int = 4) -> DataFrame:
    """(bucket, borrowed, id, text): docs by descending id in each bucket of a partition, then, borrowed, the row that follows the bucket's last in the whole order. After the smallest id comes the largest.

    Nulls come after all ids; rows that share an id are ordered by hash and text, so equal rows differ in nothing. Each text is shuffled once; a bucket holds the ids between two quantiles, of which there are
    per_task for each shuffle partition, and so has the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * per_task
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("cuts")).first()["cuts"] if n > 1 else None
    bucket = _bucket(sorted(set(cuts or ())))
    firsts = sorted(rows.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("id")).collect())  # a row for each bucket
    follows = [(r["id"], firsts[(i + 1) % len(firsts)]["bucket"]) for i, r in enumerate(firsts)]
    lent = F.broadcast(spark.createDataFrame(follows, "first long, bucket int"))
    own = rows.select(bucket.cast("int").alias("bucket"), F.lit(False).alias("borrowed"), "id", "text")
    borrowed = rows.join(lent, F.col("id").eqNullSafe(F.col("first"))).select("bucket", F.lit(True).alias("borrowed"), "id", "text")
    return own.unionAll(borrowed).repartition(parts, "bucket").sortWithinPartitions("bucket", "borrowed", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")


def fingerprint_with_edits(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row of docs the fingerprint, that of its edited text, and its likeness to that and to the next row's; columns as in op12.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next row's text; the order is in_order()'s, and a single row is followed by itself. A null text is
    empty. Every row, also one that repeats or has no id, gives a row; an empty table gives none. Other columns are ignored, whatever their names. Very long texts are read in stretches.
    """

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # bucket, id, text and chain of a row of its own whose next is still to come
        for batch in batches(it, "text"):
            texts = batch["text"].to_pylist()
            rows = list(zip(batch["bucket"].to_pylist(), batch["borrowed"].to_pylist(), batch["id"].to_pylist(), texts, chains([t.encode() for t in texts], ranks), strict=True))
            pairs = []
            for bucket, borrowed, i, text, chain in rows:
                if last and last[0] == bucket:
                    pairs.append((*last[1:], text, chain))
                last = None if borrowed else (bucket, i, text, chain)
            if not pairs:
                continue
            edited = []
            for _, text, _, after, _ in pairs:
                half = len(text) // 2
                edited.append((text[: len(text) - half] + after[:half]).encode())
            out = []
            for (i, text, chain, _, following), new, changed in zip(pairs, edited, _in_passes(edited, ranks), strict=True):
                out.append((i, len(text), hashlib.sha256(new).hexdigest(), text_of(chain), text_of(changed), likeness(chain, changed), likeness(chain, following)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)

    return mapped(in_order(docs, id_col, text_col), compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _in_passes(texts: list[bytes], ranks: np.ndarray) -> Iterator[Chain]:
    """chains(), some texts at a time, and a very long one alone."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > common.PASS_BYTES:
            yield from chains(some, ranks)
            some, size = [], 0
        some.append(t)
        size += len(t)
    yield from chains(some, ranks) if some else ()


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; ranks are counted over all of documents."""
    docs = table(spark, sf_dir, "documents")
    return fingerprint_with_edits(docs, rarities(docs))
