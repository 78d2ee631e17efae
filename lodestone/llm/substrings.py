"""Substring dedup by level-wise doubling: words in any window of 35 words whose sequence starts elsewhere too are removed.

Level 1 looks at short windows, about a quarter as long. Instead of all of them it takes, for each full window, the one that a fixed hash
of its words picks; equal full windows pick equal ones, at the same place, so that none is missed, and a sixteenth of the starts
is shuffled. Those that stand at two places or more are extended to twice the length, to either side, within the full windows that
picked them; of these, again, only repeated ones are extended to full windows. Repeats are found by hashes of the words: 64 bits where a
collision only costs work, 128 bits at full length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Rolling, Words, among, batches, cut_text, dropped, long_text, mapped, mixed, signed, stretches, table, with_key, written

WINDOW = 35
_FIRST, _SECOND = Rolling(0xD6E8FEB86659FD93), Rolling(0xA0761D6478BD642F)
_LOW = np.uint64(0xFFFFFFFF)


class Windows:
    """The windows of a batch of texts, and the short window that each picks."""

    def __init__(self, words: Words, window: int):
        self.mid = -(-window // 2)
        self.seed = -(-self.mid // 2)
        self.window, self.words = window, words
        w = words
        self.sums, self.sums2 = _FIRST.sums(w.hashes), _SECOND.sums(w.hashes2)
        n = len(w.starts)
        end = w.first[1:][w.doc] if n else np.empty(0, int)
        at = np.arange(n)
        self.starts = at[at + window <= end]  # first words of full windows
        if len(self.starts):
            seeds = np.arange(n - self.seed + 1)
            v = (self.hash(seeds, self.seed) & ~_LOW) | seeds.astype(np.uint64)
            reach, span = 1, window - self.seed + 1
            while reach * 2 <= span:
                v = np.minimum(v[:-reach], v[reach:])
                reach *= 2
            self.picked = (np.minimum(v[self.starts], v[self.starts + span - reach]) & _LOW).astype(np.int64)
        else:
            self.picked = np.empty(0, np.int64)

    def hash(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _FIRST.spans(self.sums, starts, starts + length)

    def hash2(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _SECOND.spans(self.sums2, starts, starts + length)

    def texts(self) -> list[np.ndarray]:
        """Both hashes of all words of each text."""
        return [roll.spans(sums, self.words.first[:-1], self.words.first[1:]) for roll, sums in ((_FIRST, self.sums), (_SECOND, self.sums2))]

    def right(self) -> np.ndarray:
        """Whether the picked window is extended to the right within the full window; else to the left."""
        return self.picked - self.starts <= self.window - self.mid

    def doubled(self, picks: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(right, picks, picks + self.seed - self.mid)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Lists of each owner's values; owner ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _picks(win: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first words of the picked short windows, their hashes, and those of their doubles to the right and to the left, where some full window needs that side; 0 else."""
    picks = np.unique(win.picked)
    right, sides = win.right(), []
    for side in (True, False):
        h = np.zeros(len(picks), np.uint64)
        need = np.isin(picks, win.picked[right == side])
        h[need] = win.hash(win.doubled(picks[need], np.full(int(need.sum()), side)), win.mid)
        sides.append(h)
    return picks, win.hash(picks, win.seed), *sides


def _long_scan(text: bytes, window: int) -> tuple:
    """What _scan finds in one long text, stretch by stretch: number of words, two hashes and the SHA-256 of them, picks."""
    n, parts, sums, sha = 0, [], [0, 0], hashlib.sha256()
    for w, again, piece in stretches(text, window - 1, second=True):
        base, fresh = n - again, len(w.starts) - again
        win = Windows(w, window)
        picks, seed, right, left = _picks(win)
        parts.append((picks + base, seed, right, left))
        for k, (roll, own) in enumerate(((_FIRST, win.sums), (_SECOND, win.sums2))):
            sums[k] = (sums[k] + pow(roll.base, base, 1 << 64) * (int(own[-1]) - int(own[again]))) % (1 << 64)
        if fresh:
            sha.update((b" " if n else b"") + b" ".join(piece[int(w.starts[again]) :].split()))
        n += fresh
    places, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    seed, sides = np.concatenate([p[1] for p in parts])[first], []
    for k in (2, 3):
        h = np.zeros(len(places), np.uint64)
        np.maximum.at(h, inverse, np.concatenate([p[k] for p in parts]))
        sides.append(h)
    return n, [int(mixed(np.array([x], np.uint64)).view(np.int64)[0]) for x in sums], sha.hexdigest(), places, seed, *sides


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """Of each of docs (key, doc_id, text): words, two hashes of all of them, hash of the text kept if none goes, and the picks with their hashes."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            text = batch["text"].cast(pa.large_binary())
            long = long_text(text)
            if long is not None:
                count, both, sha, places, seed, right, left = _long_scan(long, window)
                count, whole, sha, owner = [count], [[x] for x in both], [sha], np.zeros(len(places), np.int64)
            else:
                win = Windows(Words(text, second=True), window)
                w = win.words
                places, seed, right, left = _picks(win)
                owner = w.doc[places] if len(places) else places
                places = places - w.first[:-1][owner] if len(places) else places
                count, whole = np.diff(w.first), [signed(x) for x in win.texts()]
                sha = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in text.to_pylist()]
            lists = [_lists(x, owner, len(text), kind) for x, kind in ((signed(seed), pa.int64()), (places, pa.int32()), (signed(right), pa.int64()), (signed(left), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], pa.array(count, pa.int64()), *(pa.array(x, pa.int64()) for x in whole), pa.array(sha), *lists], ["key", "doc_id", "n_words", "h1", "h2", "sha", "seeds", "places", "rights", "lefts"])

    return mapped(docs, read, "key long, doc_id long, n_words long, h1 long, h2 long, sha string, seeds array<long>, places array<int>, rights array<long>, lefts array<long>")


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys more than one row has. Counts are summed before the shuffle; since they are a table of their own, Spark can split the join's hot keys."""
    often = written(rows.groupBy(*keys).agg(F.count("*").alias("often")).filter("often > 1").drop("often"), "repeated")
    return rows.join(often, list(keys))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """docs (key, doc_id, text), of which each row has a key of its own, scanned: a row for each, and rows (key, text, starts) with the first words of the repeated windows.

    Documents with equal words are copies: all windows of all of them repeat, so only the one with the smallest key goes on, for others. What is counted is a table of its own each time,
    so that Spark can split the join of a hot group.
    """
    scanned = written(_scan(docs, window), "windows")
    long_enough = scanned.filter(F.col("n_words") >= window)
    copies = written(long_enough.groupBy("h1", "h2").agg(F.min("key").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "groups")
    marked = written(long_enough.select("key", "h1", "h2").join(copies, ["h1", "h2"]).select("key", (F.col("key") != F.col("keeper")).alias("later")), "copies")
    single = long_enough.join(marked.filter("later").select("key"), "key", "left_anti")
    seeds = single.select("key", F.explode(F.arrays_zip("seeds", "places", "rights", "lefts")).alias("x")).select("key", F.col("x.seeds").alias("h"), F.col("x.places").alias("place"), F.col("x.rights").alias("r"), F.col("x.lefts").alias("l"))
    level1 = written(_repeated(seeds, "h").drop("h"), "level1")  # read twice; else all picks are shuffled twice
    sides = level1.select("key", "place", F.explode(F.array(F.struct(F.lit(True).alias("right"), F.col("r").alias("h")), F.struct(F.lit(False).alias("right"), F.col("l").alias("h")))).alias("x")).select("key", "place", "x.right", "x.h").filter("h != 0")
    level2 = written(_repeated(sides, "h").groupBy("key").agg(F.collect_set(F.when(F.col("right"), F.col("place")).otherwise(-1 - F.col("place"))).alias("picks")), "level2")
    held = written(among(docs.select("key", "text"), level2, "key").join(level2, "key"), "held")  # most texts have no pick left, and are not shuffled
    dropped(level1, level2)

    def full(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            lists = batch["picks"]
            coded = np.asarray(pc.list_flatten(lists)).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            right = coded >= 0
            place = np.where(right, coded, -1 - coded)
            long, keys = long_text(batch["text"]), batch["key"].to_numpy()
            if long is None:
                w = Words(batch["text"], second=True)
                yield _starts(w, window, keys[w.doc], place + w.first[:-1][owner], right, w.first[:-1][w.doc])
                continue
            base = 0
            for w, again, _ in stretches(long, window - 1, second=True):
                base -= again
                here = (place >= base) & (place < base + len(w.starts))
                yield _starts(w, window, np.broadcast_to(keys, len(w.starts)), place[here] - base, right[here], np.broadcast_to(-base, len(w.starts)))
                base += len(w.starts)

    whole = mapped(held, full, "h1 long, h2 long, key long, start int")
    starts = _repeated(whole, "h1", "h2").groupBy("key").agg(F.collect_list("start").alias("starts"))
    return scanned.join(marked, "key", "left"), held.select("key", "text").join(starts, "key")


def _starts(w: Words, window: int, keys: np.ndarray, places: np.ndarray, right: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """The full windows whose pick is alive, with both hashes; keys: of the document of each word, first: what is taken from a word's number to count from the document's first."""
    win = Windows(w, window)
    go = np.isin(2 * win.picked + win.right(), np.unique(2 * places + right))
    starts = win.starts[go]
    return pa.RecordBatch.from_arrays([pa.array(signed(win.hash(starts, window))), pa.array(signed(win.hash2(starts, window))), pa.array(keys[starts], pa.int64()), pa.array(starts - first[starts], pa.int32())], ["h1", "h2", "key", "start"])


def _cut(text: bytes, starts: np.ndarray, window: int) -> tuple[int, str, str]:
    """Words that go, the others joined, and the SHA-256 of that; starts: first words of repeated windows. Long texts are split a stretch at a time."""
    edge = np.zeros(int(starts.max()) + window + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    out = np.cumsum(edge) > 0
    kept, n = [], 0
    for piece in cut_text(text):
        words = piece.split()
        gone = out[n : n + len(words)]
        n += len(words)
        left = [x for x, o in zip(words, gone.tolist(), strict=False) if not o] + words[len(gone) :]
        if left:
            kept.append(b" ".join(left))
    whole = b" ".join(kept)
    return int(out.sum()), whole.decode(), hashlib.sha256(whole).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of each row of docs; kept is null where no word goes.

    kept: the words left, joined by one space; kept_sha256: SHA-256 of their UTF-8 bytes. A null or empty text has no words. Every row is a document of its own, also where
    doc_ids are null or repeat. An empty table gives no rows. Texts are read whole, very long ones in stretches. Other columns are ignored, whatever their names.
    """
    own, key = with_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id")
    scanned, repeats = repeated_windows(own.withColumnRenamed(key, "key"), window)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            rows = [_cut(text, np.asarray(starts), window) for text, starts in zip(batch["text"].cast(pa.large_binary()).to_pylist(), batch["starts"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["key"], *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))], ["key", "gone", "left", "left_sha"])

    cuts = mapped(repeats, cut, "key long, gone long, left string, left_sha string")
    copy = F.col("later").isNotNull()
    return scanned.select("key", "doc_id", "n_words", "sha", "later").join(cuts, "key", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("left")).alias("kept"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
