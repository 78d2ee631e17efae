"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's shingle hashes are dealt to bins by one hash function; each bin keeps its smallest, and an empty bin borrows that of a full bin picked by
a hash of its number and of the attempt (Shrivastava, 2017). Bands of bins make buckets. In a bucket the documents are compared with its
first one, a star; only where that leaves members unconnected do further members become centres, in growing numbers, so that the pairs of a bucket that
could still join components are all looked at, and those of one component are not. Pairs are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Rolling, Words, batches, dropped, long_text, mapped, mixed, signed, stretches, table, with_key, written
from lodestone.llm.graph import components

#: 24 bands of 5 bins find two sets with a similarity of 0.85 with a probability of 1 - 8e-7.
BANDS, ROWS = 24, 5
#: Parts of a bucket that are ranked by themselves.
SALTS = 16
_SHINGLES = Rolling(0xE7037ED1A0B428DB)
_TRIES = 64


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each distinct shingle of each text, sorted by owner and hash.

    A shingle is `size` consecutive words, A-Z lower-cased; a text with fewer words, but at least one, has the sequence of all. A single long text is read in stretches.
    """
    whole = long_text(text)
    if whole is not None:
        parts, count = [], 0
        for w, again, _ in stretches(whole, size - 1, lower=True):
            count += len(w.starts) - again
            parts.append(np.unique(_shingles(w, size)[1]) if len(w.starts) >= size else np.empty(0, np.uint64))
        if count >= size:
            h = np.unique(np.concatenate(parts))
            return np.zeros(len(h), np.int64), h
    w = Words(text, lower=True)
    owner, h = _shingles(w, size)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        owner, h = np.concatenate((owner, short)), np.concatenate((h, _SHINGLES.spans(_SHINGLES.sums(w.hashes), w.first[short], w.first[short + 1])))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], h[fresh]


def _shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(w.starts))
    end = w.first[1:][w.doc] if len(at) else at
    starts = at[at + size <= end]
    return w.doc[starts], _SHINGLES.spans(_SHINGLES.sums(w.hashes), starts, starts + size)


def signatures(owner: np.ndarray, h: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One-permutation signatures, densified, of n sets; a row for each set, meaningless for an empty one."""
    x = mixed(h)
    bin_of = ((x >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * bins, none)
    np.minimum.at(sig, owner * bins + bin_of, mixed(x ^ np.uint64(0x5851F42D4C957F2D)))
    sig = sig.reshape(n, bins)
    full = sig != none
    out = sig.copy()
    open_row, open_bin = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(open_row):
        attempt += 1
        # the same for every set: where bin b looks at its k-th attempt
        if attempt <= _TRIES:
            source = (mixed(open_bin.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        else:
            source = (open_bin + attempt) % bins
        hit = full[open_row, source]
        out[open_row[hit], open_bin[hit]] = mixed(sig[open_row[hit], source[hit]] + np.uint64(attempt))
        open_row, open_bin = open_row[~hit], open_bin[~hit]
    return out


def _sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(key, doc_id, n, h1, h2, bands): size and hash of the set of each of docs (key, doc_id, text), and its bucket in each band."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            n = len(batch)
            owner, h = shingle_sets(batch["text"], size)
            count = np.bincount(owner, minlength=n)
            both = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            for k, out in enumerate(both):
                np.add.at(out, owner, mixed(h + np.uint64(k + 1)))
            sig = signatures(owner, h, n, bands * rows).reshape(n, bands, rows)
            bucket = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
            for r in range(rows):
                bucket = mixed(bucket * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            alive = count > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(alive * bands))), pa.int32()), pa.array(signed(bucket[alive].reshape(-1))))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], pa.array(count, pa.int64()), *(pa.array(signed(b)) for b in both), lists], ["key", "doc_id", "n", "h1", "h2", "bands"])

    return mapped(docs, read, "key long, doc_id long, n long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of documents."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            owner, h = shingle_sets(batch["text"], size)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(batch) + 1)), pa.int32()), pa.array(signed(h)))
            yield pa.RecordBatch.from_arrays([batch["key"], lists], ["id", "shingles"])

    return mapped(docs, read, "id long, shingles array<long>")


def _enough(common, a, b, percent: int):
    return common * 100 >= percent * (a + b - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; the side with many pairs for one id comes last, so that its join can be split."""
    left, right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "b").join(right, "a").filter(_enough(common, F.size("x"), F.size("y"), percent)).select("a", "b")


def near_duplicate_links(sketch: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, component) of the representatives that are linked, written; sketch: one row for each distinct set, written.

    What a key's rows are joined with is a table of its own each time, summed or limited before, so that Spark can split the join of a hot bucket.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    buckets = sketch.select("key", "n", F.explode("bands").alias("bucket"))
    several = keep(buckets.groupBy("bucket").agg(F.min("key").alias("first"), F.count("*").alias("many")).filter("many > 1").drop("many"), "buckets")
    members = keep(buckets.join(several, "bucket").select(F.col("bucket").alias("key"), F.col("key").alias("id"), "n", "first"), "members")
    ids = members.select("id").distinct()
    sets = keep(_sets(docs.join(ids.withColumnRenamed("id", "key"), "key", "left_semi"), size), "sets")
    heads = keep(members.filter("id = first").select("key", F.col("n").alias("n_first")), "heads")
    stars = members.filter("id != first").join(heads, "key").filter(_enough(F.least("n", "n_first"), F.col("n"), F.col("n_first"), percent)).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = keep(stars, "stars")
    comps = keep(components(_confirmed(stars, sets, percent)), "components")
    # shingles that no other member has bound what a pair can share; they are counted where a star left something open
    left = keep(_still_open(members, comps, keep).filter("id != first").drop("comp", "first"), "open")
    if left.limit(1).count():
        own = sets.join(left.select("id").distinct(), "id", "left_semi")
        alone = own.select(F.explode("shingles").alias("s"), "id").groupBy("s").agg(F.count("*").alias("df"), F.min("id").alias("id")).filter("df = 1").groupBy("id").agg(F.count("*").alias("alone"))
        bound = F.col("n") - F.coalesce("alone", F.lit(0))
        left = keep(left.join(alone, "id", "left").withColumn("most", bound).filter(_enough(F.col("most"), F.col("most"), F.col("n"), percent)).drop("alone"), "open")
        left = keep(left.join(_distances(left, members, sets, keep), "id").join(sketch.select(F.col("key").alias("id"), "bands"), "id"), "open")
        left = keep(_still_open(left, comps, keep), "open")
    checked, many = stars, 8
    while left.limit(1).count():
        own = ("id", "n", "most", "pivot", "apart", "shared", "comp", "bands")
        centres = keep(_first(left, many).select("key", *(F.col(c).alias(f"{c}_a") for c in own)), "centres")
        others = left.select("key", *(F.col(c).alias(f"{c}_b") for c in own))
        # |x - y| + |y - x| is at least what both differ from their pivot by, less twice what of it can be the same
        far = F.col("apart_a") + F.col("apart_b") - 2 * F.least("shared_a", "shared_b")
        near = (F.col("pivot_a") != F.col("pivot_b")) | (far * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
        here = F.col("key") == F.array_min(F.array_intersect("bands_a", "bands_b"))  # a pair comes from one of its buckets alone
        pairs = others.join(centres, "key").filter((F.col("comp_a") != F.col("comp_b")) & near & _enough(F.least("most_a", "most_b"), F.col("n_a"), F.col("n_b"), percent) & here)
        pairs = pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        so_far = comps.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))  # joins what the links so far do
        comps = keep(components(so_far.unionAll(_confirmed(pairs, sets, percent))), "components")
        checked = checked.unionAll(pairs)
        rest = left.drop("comp").join(centres.select("key", F.col("id_a").alias("id")), ["key", "id"], "left_anti")
        left, many = keep(_still_open(rest, comps, keep), "open"), many * 8
    dropped(*(df for df in made if df is not comps))
    return comps


def _distances(left: DataFrame, members: DataFrame, sets: DataFrame, keep) -> DataFrame:
    """(id, pivot, apart, shared): a document that starts a bucket of it, how many shingles just one of both has, and how many of those stand in
    the same place for another document with that pivot."""
    pivots = members.join(left.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("first").alias("pivot"))
    both = pivots.join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("p")), "pivot")
    apart = keep(both.select("id", "pivot", F.concat(F.array_except("shingles", "p"), F.array_except("p", "shingles")).alias("d")), "apart")
    each = apart.select("id", "pivot", F.explode("d").alias("s"))
    alone = each.groupBy("pivot", "s").agg(F.count("*").alias("df"), F.min("id").alias("id")).filter("df = 1").groupBy("id").agg(F.count("*").alias("own"))
    return apart.select("id", "pivot", F.size("d").alias("apart")).join(alone, "id", "left").select("id", "pivot", "apart", (F.col("apart") - F.coalesce("own", F.lit(0))).alias("shared"))


def _first(members: DataFrame, many: int) -> DataFrame:
    """The first members of each key, ranked in salted parts before all of a key meet."""
    order = (F.col("n") - F.col("most"), "id")
    part = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = part.withColumn("at", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).filter(F.col("at") <= many)
    return part.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("at") <= many).drop("at", "salt")


def _with_comp(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def _still_open(members: DataFrame, comps: DataFrame, keep) -> DataFrame:
    """The members, with their component, of buckets that hold more than one."""
    own = _with_comp(members, comps)
    several = keep(own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key"), "keys")
    return own.join(several, "key")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 3, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs; linked are those that share at least `percent` of the union of their shingles.

    component_id is the smallest doc_id that links reach, kept says that it is the row's own. Rows with equal sets are one from the start. A null or empty text, or one
    of white space, has no shingles and is linked with nothing. Rows that share a doc_id are documents of their own; one with a null doc_id is linked with nothing and kept. An
    empty table gives no rows. Texts are read whole, very long ones in stretches, no bucket is cut, other columns are ignored, whatever their names.
    """
    own, key = with_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id")
    own = own.withColumnRenamed(key, "key")
    sketch = written(_sketch(own, size, bands, rows), "sketch")
    usable = sketch.filter("n > 0 and doc_id is not null")
    classes = written(usable.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("h1", "h2", "n", F.col("least.doc_id").alias("doc_id"), F.col("least.key").alias("key")), "classes")
    distinct = written(usable.join(classes.select("key"), "key", "left_semi"), "distinct")
    comps = near_duplicate_links(distinct, own, size, percent)
    linked = classes.join(comps.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # a component is named by a key, which need not ascend with the ids
    least = written(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    named = written(linked.join(least, "component").select("h1", "h2", "n", "component_id"), "named")
    dropped(distinct, comps, least, classes)
    with_words = usable.join(named, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    without = sketch.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.unionAll(without).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
