"""Quality classification by co-training.

Two logistic classifiers see each document by separate views: its text content (hashed pairs of neighbouring characters and
statistics of its words) and its page metadata (source, language, size and line layout). Over some rounds each scores all unlabelled documents and labels those of which it is
surest for the other. Both are then calibrated on labelled rows kept apart, and the calibrated views are combined into the score of every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Words, batches, dropped, long_text, mapped, one_row_per_id, stretches, table, written

#: Labelled rows that a fit reads, about: ids are drawn by a hash, so that this many are expected at most, and never more than twice as many are taken.
MAX_LABELLED = 8_000
ROUNDS, SURE, PER_ROUND = 3, 0.95, 1_000
#: Documents below this score are rejected.
THRESHOLD = 0.5
#: Words that a text needs for its view to count in full; with fewer its logit shrinks towards that of the labels' mean.
ENOUGH_WORDS = 10
#: The columns that scoring adds.
SCORES = ("p_text", "p_meta", "quality_score", "quality_kept")
_PAIRS, _WORD_STATS = 256, 9
_SOURCES, _LANGS, _LAYOUT = 64, 16, 6
TEXT_SIZE, META_SIZE = _PAIRS + _WORD_STATS, _SOURCES + _LANGS + _LAYOUT
_KINDS = np.zeros((4, 256), bool)
_KINDS[0, 65:91] = True  # A-Z
_KINDS[1, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # ASCII punctuation
_KINDS[2, 48:58] = True
_KINDS[3, 10] = True


def _bucket(value: str | None, size: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode("utf-8", "surrogatepass")) % (size - 1)


def _pair_buckets(data: np.ndarray) -> np.ndarray:
    return ((data[:-1].astype(np.uint32) * 257 + data[1:]) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64)


def _counted(text: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each text: counts of pair buckets, of kinds of bytes, bytes, words, distinct words, times of the most frequent, words equal to the one before, bytes in words."""
    words, n = Words(text), len(text)
    data, size = words.data, np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)
    owner = np.repeat(np.arange(n), size)
    pairs = np.zeros((n, _PAIRS), np.int64)
    if len(data) > 1:
        same = owner[1:] == owner[:-1]
        pairs = np.bincount(owner[1:][same] * _PAIRS + _pair_buckets(data)[same], minlength=n * _PAIRS).reshape(n, _PAIRS)
    kinds = np.stack([np.bincount(owner, k[data], n) if len(data) else np.zeros(n) for k in _KINDS])
    order = np.lexsort((words.hashes, words.doc))
    h, d = words.hashes[order], words.doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    top = np.zeros(n)
    if len(h):
        np.maximum.at(top, d[fresh], np.diff(np.append(np.flatnonzero(fresh), len(h))))
    again = np.bincount(words.doc[1:][(words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n)
    return pairs, kinds, size, np.diff(words.first), np.bincount(d[fresh], minlength=n), top, again, np.bincount(words.doc, words.ends - words.starts, n)


def _long_counted(text: bytes) -> tuple[np.ndarray, ...]:
    """The same of one long text, stretch by stretch."""
    pairs, kinds, again, inside, count, last, before = np.zeros(_PAIRS, np.int64), np.zeros(4), 0, 0, 0, None, b""
    seen = np.empty(0, np.uint64), np.empty(0, np.int64)
    for w, _, piece in stretches(text):
        pairs += np.bincount(_pair_buckets(np.frombuffer(before + piece, np.uint8)), minlength=_PAIRS)
        kinds += [np.count_nonzero(k[w.data]) for k in _KINDS]
        before = piece[-1:] or before
        if len(w.hashes):
            again += np.count_nonzero(w.hashes[1:] == w.hashes[:-1]) + int(w.hashes[0] == last if last is not None else 0)
            last, inside, count = w.hashes[-1], inside + int((w.ends - w.starts).sum()), count + len(w.hashes)
            h, times = np.unique(w.hashes, return_counts=True)
            h, at = np.unique(np.concatenate((seen[0], h)), return_inverse=True)
            seen = h, np.bincount(at, np.concatenate((seen[1], times)), len(h)).astype(np.int64)
    one = lambda x: np.array([x])
    return pairs[None], kinds[:, None], one(len(text)), one(count), one(len(seen[0])), one(float(seen[1].max(initial=0))), one(again), one(float(inside))


def features(text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of a batch, a row for each text, in single precision rounded to half; nulls count as empty texts and a value of their own."""
    n, long = len(text), long_text(text)
    pairs, kinds, size, count, distinct, top, again, inside = _counted(text) if long is None else _long_counted(long)
    some = np.maximum(count, 1)
    t = np.zeros((n, TEXT_SIZE), np.float32)
    t[:, :_PAIRS] = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])
    s = t[:, _PAIRS:]
    s[:, 0], s[:, 1], s[:, 2] = kinds[0] / np.maximum(size, 1), kinds[1] / np.maximum(size, 1), kinds[2] / np.maximum(size, 1)
    s[:, 3], s[:, 4], s[:, 5] = distinct / some, top / some, again / some
    s[:, 6] = np.log1p(distinct) / np.log1p(some)
    s[:, 7] = np.minimum(inside / some, 50) / 10
    s[:, 8] = np.log1p(count) / 10
    m = np.zeros((n, META_SIZE), np.float32)
    m[np.arange(n), [_bucket(x, _SOURCES) for x in source.to_pylist()]] = 1
    m[np.arange(n), _SOURCES + np.array([_bucket(x, _LANGS) for x in lang.to_pylist()], int)] = 1
    rest = m[:, _SOURCES + _LANGS :]
    rest[:, 0], rest[:, 1] = np.log1p(size) / 10, np.log1p(kinds[3]) / 5
    rest[:, 2] = np.log1p(size / (kinds[3] + 1)) / 10
    for k, low in enumerate((1_000, 5_000, 20_000)):
        rest[:, 3 + k] = size > low
    return t.astype(np.float16).astype(np.float32), m.astype(np.float16).astype(np.float32)


@dataclass
class View:
    """A logistic classifier on standardised features, and the scale and shift that calibrate its logit."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weight[1:] + self.weight[0]
        return np.clip(self.calibration[0] * raw + self.calibration[1], -30, 30)


@dataclass
class Model:
    text: View
    meta: View
    weights: np.ndarray  # of 1 and both calibrated logits
    prior: float  # logit of the labels' mean

    def scores(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        share = np.minimum(1, np.expm1(t[:, -1].astype(float) * 10) / ENOUGH_WORDS)
        a, b = share * self.text.logit(t) + (1 - share) * self.prior, self.meta.logit(m)
        return np.stack([_sigmoid(a), _sigmoid(b), _sigmoid(np.clip(self.weights[0] + self.weights[1] * a + self.weights[2] * b, -30, 30))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    x = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _view(x: np.ndarray, y: np.ndarray) -> View:
    x = x.astype(float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    return View(mean, scale, _newton((x - mean) / scale, y, 3.0))


#: Of rows that one view is surest of: view, label, number of the row, features.
Sure = tuple[int, int, int, np.ndarray]


def cotrain(t: np.ndarray, m: np.ndarray, y: np.ndarray, surest: Callable[[list[View], list[set[int]]], list[Sure]], rounds: int = ROUNDS) -> Model | None:
    """A model from labelled rows (y of 0 and 1); None unless y has both labels.

    surest(views, taken): the unlabelled rows that each view labels for the other, but for those that the other has taken already.
    """
    if len(np.unique(y)) < 2:
        return None
    apart = np.arange(len(y)) % 4 == 0
    if len(np.unique(y[apart])) < 2 or len(np.unique(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    views, extra = [t, m], [[], []]
    taken: list[set[int]] = [set(), set()]

    def fitted(k: int) -> View:
        more = [x for x, _ in extra[k]]
        return _view(np.concatenate((views[k][~apart], np.array(more, np.float32).reshape(len(more), views[k].shape[1]))), np.concatenate((y[~apart], [label for _, label in extra[k]])))

    now = [fitted(0), fitted(1)]
    for _ in range(rounds):
        found = surest(now, taken)
        for k, label, row, x in found:
            taken[1 - k].add(row)
            extra[1 - k].append(((x[TEXT_SIZE:] if k == 0 else x[:TEXT_SIZE]), float(label)))
        if not found:
            break
        now = [fitted(0), fitted(1)]
    held = apart if apart.any() else np.ones(len(y), bool)
    for k in (0, 1):
        w = _newton(now[k].logit(views[k][held])[:, None], y[held], 1e-2)
        now[k].calibration = (max(float(w[1]), 0.0), float(w[0]))
    both = np.column_stack((now[0].logit(t[held]), now[1].logit(m[held])))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return Model(now[0], now[1], _newton(both, y[held], 1e-2), float(np.log(share / (1 - share))))


def _split(x: bytes | np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views of n rows of features."""
    own = np.frombuffer(x, np.float16).reshape(n, TEXT_SIZE + META_SIZE).astype(np.float32)
    return own[:, :TEXT_SIZE], own[:, TEXT_SIZE:]


def viewed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(row, doc_id, label, filled, x) of docs (doc_id, text, lang, source), written: a hash of its id and features, which doesn't hang on how rows lie, its label if known (doc_id, label) has one, whether it has text, its
    features as bytes of half precision. Features are shuffled once at most, for the labels; rows without an id are dealt by their hash."""

    def seen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            x = np.concatenate(features(batch["text"], batch["lang"], batch["source"]), 1).astype(np.float16)
            filled = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0)) > 0
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(filled), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "filled", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    rows = mapped(own, seen, "doc_id long, filled boolean, x binary").select(F.xxhash64("doc_id", "x").alias("row"), "doc_id", "filled", "x")
    keyed = rows.withColumns({"_key": F.coalesce("doc_id", "row"), "_has": F.col("doc_id").isNotNull()})
    named = known.select(F.col("doc_id").alias("_key"), F.lit(True).alias("_has"), "label")
    return written(keyed.join(named, ["_key", "_has"], "left").select("row", "doc_id", "label", "filled", "x"), "views")


def _known(labels: DataFrame, label_col: str) -> DataFrame:
    return one_row_per_id(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)"), "doc_id", "label")


def surest(rows: DataFrame, views: list[View], taken: list[set[int]], sure: float = SURE, most: int = PER_ROUND) -> list[Sure]:
    """Of rows (row, x), the `most` that each view is surest of for each label, at least `sure`, that the other view hasn't taken; each task sends as many of its own at most. Equally sure ones go by `row`; those that share it
    are equal."""
    sent = rows.sparkSession.sparkContext.broadcast((views, [np.array(sorted(x), np.int64) for x in taken]))

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, taken = sent.value
        held = {(k, label): (np.empty(0), np.empty(0, np.int64), np.empty(0, object)) for k in (0, 1) for label in (1, 0)}
        for batch in it:
            row, x = batch["row"].to_numpy(), batch["x"].to_pylist()
            for k, own in enumerate(_split(b"".join(x), len(x))):
                p = _sigmoid(views[k].logit(own))
                free = ~np.isin(row, taken[1 - k])
                for label, how in ((1, p), (0, 1 - p)):
                    some = np.flatnonzero((how >= sure) & free)
                    if len(some):
                        how_, row_, x_ = (np.concatenate(z) for z in zip(held[k, label], (how[some], row[some], np.array([x[i] for i in some], object)), strict=True))
                        first = np.lexsort((row_, -how_))[:most]
                        held[k, label] = how_[first], row_[first], x_[first]
        for (k, label), (how, row, x) in held.items():
            if len(how):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(how), k), pa.int32()), pa.array(np.full(len(how), label), pa.int32()), pa.array(how), pa.array(row, pa.int64()), pa.array(list(x), pa.binary())], ["k", "label", "how", "row", "x"])

    found = written(mapped(rows.select("row", "x"), best, "k int, label int, how double, row long, x binary"), "sure")
    parts = [found.filter((F.col("k") == k) & (F.col("label") == label)).orderBy(F.col("how").desc(), "row").limit(most) for k in (0, 1) for label in (1, 0)]
    got = reduce(DataFrame.unionAll, parts).collect()  # four times `most` rows
    dropped(found)
    return [(r["k"], r["label"], r["row"], np.concatenate(_split(bytes(r["x"]), 1), 1)[0]) for r in sorted(got, key=lambda r: (r["k"], -r["label"], -r["how"], r["row"]))]


def _fitted(rows: DataFrame, known: DataFrame, max_labelled: int) -> Model | None:
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_labelled / max(n, 1)))).limit(2 * max_labelled)
    usable = rows.filter("doc_id is not null and filled")
    mine = usable.filter("label is not null").join(F.broadcast(drawn.select("doc_id")), "doc_id")
    picked = mine.groupBy("doc_id", "label").agg(F.min(F.struct("row", "x")).alias("first")).select("doc_id", "label", "first.x").orderBy("doc_id").toPandas()  # one row of an id
    y = picked["label"].to_numpy(float)
    t, m = _split(b"".join(picked["x"]), len(picked))
    if len(np.unique(y)) < 2:
        return None
    pool = usable.filter("label is null")
    return cotrain(t, m, y, lambda views, taken: surest(pool, views, taken))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model from about max_labelled rows of docs with a label, drawn by a hash of doc_id, one for each id (of several texts that with the smallest hash), and from all rows without one. The same rows give the same model, however they
    lie. None without labels of both kinds."""
    known = _known(labels, label_col)
    rows = viewed(docs, known)
    model = _fitted(rows, known, max_labelled)
    dropped(rows)
    return model


def _judged(model: Model | None, t: np.ndarray, m: np.ndarray, filled: np.ndarray) -> np.ndarray:
    p = model.scores(t, m) if model else np.ones((3, len(t)))
    p[:, ~filled] = 0
    return p


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with p_text and p_meta (what each calibrated view gives for good quality), quality_score and quality_kept.

    A null or empty text has score 0 and is rejected. Without a model (no labels of both kinds) every other row has score 1. Rows are judged one by one, so repeats and null
    ids do no harm; an empty table gives no rows. Texts are read whole, long ones in stretches. Columns of docs with the names of the new ones are replaced, others pass through.
    """
    new = SCORES
    kept = [c for c in docs.columns if c not in new]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    schema = docs.select(*kept).schema
    for c in new[:3]:
        schema = schema.add(c, "double", False)
    schema = schema.add(new[3], "boolean", False)

    def rate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            text = batch["text"].cast(pa.string())
            p = _judged(sent.value, *features(text, batch["lang"].cast(pa.string()), batch["source"].cast(pa.string())), np.asarray(pc.fill_null(pc.binary_length(text), 0)) > 0)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *map(pa.array, p), pa.array(p[2] >= threshold)], [*kept, *new])

    return mapped(docs.select(*kept), rate, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, p_text, p_meta, quality_score, quality_kept) of each row of docs, by a model co-trained on docs and labels; texts are read once. Odd rows and tables: as in score()."""
    known = _known(labels, label_col)
    rows = viewed(docs, known)
    sent = docs.sparkSession.sparkContext.broadcast(_fitted(rows, known, max_labelled))

    def rate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            p = _judged(sent.value, *_split(b"".join(batch["x"].to_pylist()), batch.num_rows), batch["filled"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, p), pa.array(p[2] >= threshold)], ["doc_id", "p_text", "p_meta", "quality_score", "quality_kept"])

    return mapped(rows.select("doc_id", "filled", "x"), rate, "doc_id long, p_text double, p_meta double, quality_score double, quality_kept boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, judged by a model of documents and labels: doc_id, p_text, p_meta, quality_score, quality_kept."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
