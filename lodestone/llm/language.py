"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, other characters than letters become blanks, and every 1-, 2- and 3-gram that has a letter falls into one of
`buckets` buckets by a fixed hash. Training counts are summed in Spark; the matrix of log-probabilities is broadcast,
and batches are scored in numpy by adding up the matrix rows of the n-grams that occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batches, mapped, mixed, table

#: Labelled rows that a fit reads, about: rows are drawn by a hash of their id, so that this many are expected at most.
MAX_TRAINING_ROWS = 20_000
#: The broadcast matrix has at most this many bytes; the number of buckets is halved until it fits.
MAX_MATRIX_BYTES = 32 << 20
MAX_LABELS = 1024
UNDETERMINED = "und"
_ORDERS, _PIECE = 3, 1 << 17
_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x labels

    @property
    def buckets(self) -> int:
        return len(self.log_prob)


def grams(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the texts: text index and bucket of each n-gram, and the indices of texts that have a letter in the piece."""
    parts: list[tuple[int, str]] = []
    size = 0

    def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat([i for i, _ in parts], [len(p) for _, p in parts])
        letter = _letters()[code.astype(np.int64)]
        code[~letter] = 32
        out_owner, out = [], []
        size_of = np.array([len(p) for _, p in parts])
        within = np.arange(len(code)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
        ahead = within >= _PIECE  # these characters come again in the next piece
        h, has = np.zeros(len(code), np.uint64), np.zeros(len(code), bool)
        for k in range(_ORDERS):
            n = len(code) - k
            if n <= 0:
                break
            h = (h[:n] * np.uint64(0x100000001B3)) ^ (code[k:] + np.uint64(k << 32))
            has = has[:n] | letter[k:]
            keep = has & (owner[:n] == owner[k:]) & ~ahead[:n]
            out.append((mixed(h[keep]) % np.uint64(buckets)).astype(np.int32))
            out_owner.append(owner[:n][keep])
        return np.concatenate(out_owner) if out else np.empty(0, int), np.concatenate(out) if out else np.empty(0, np.int32), np.unique(owner[letter])

    for i, text in enumerate(texts):
        text = " " + text.lower() + " "
        for at in range(0, len(text), _PIECE):
            piece = text[at : at + _PIECE + _ORDERS - 1]
            parts.append((i, piece))
            size += len(piece)
            if size >= _PIECE:
                yield counted()
                parts.clear()
                size = 0
    if parts:
        yield counted()


def fit(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS, buckets: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """A model learnt from the rows of labelled that have text and label; about max_rows of them, drawn by a hash of id_col.

    Labels are few by nature: more than MAX_LABELS raise ValueError. Without any labelled row the model has no labels.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).filter("text is not null and label is not null")
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = tuple(sorted(found))
    while labels and buckets * len(labels) * 4 > MAX_MATRIX_BYTES and buckets > 256:
        buckets //= 2
    if not labels:
        return Model((), np.zeros(0), np.zeros((1, 0), np.float32))
    total = sum(found.values())
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(labels), buckets), np.int64)
        at = {x: i for i, x in enumerate(labels)}
        for batch in batches(it, "text"):
            which = np.array([at[x] for x in batch["label"].to_pylist()])
            for owner, bucket, _ in grams(batch["text"].to_pylist(), buckets):
                sums += np.bincount(which[owner] * buckets + bucket, minlength=sums.size).reshape(sums.shape)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j], pa.int64())], ["label", "bucket", "n"])

    summed = mapped(rows.select("text", "label"), count, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most labels x buckets rows
    counts = np.full((buckets, len(labels)), 0.1)
    counts[summed["bucket"].to_numpy(int), summed["label"].to_numpy(int)] += summed["n"].to_numpy(float)
    prior = np.array([found[x] for x in labels], float)
    return Model(labels, np.log(prior / prior.sum()), np.log(counts / counts.sum(0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted label and its posterior probability; other columns pass through.

    A text that is null or has no letter gets label `und` and score 0, as does every text where the model has no labels.
    Each row is judged by itself, so repeated rows and ids do no harm; an empty table gives no rows. Ties go to the label that sorts first. Texts are read whole, long ones a
    piece at a time. Columns of docs that are named like the new ones are replaced, others pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_MATRIX_BYTES
    kept = [c for c in docs.columns if c not in out]
    schema = docs.select(*kept).schema.add(out[0], "string", False).add(out[1], "double", False)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches(it, text_col):
            texts = [t or "" for t in batch[text_col].to_pylist()]
            total, letters = np.tile(own.log_prior, (len(texts), 1)), np.zeros(len(texts), bool)
            for owner, bucket, alive in grams(texts, own.buckets) if own.labels else ():
                letters[alive] = True
                for k in range(len(own.labels)):
                    total[:, k] += np.bincount(owner, own.log_prob[bucket, k], len(texts))
            label, p = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if own.labels:
                best = total.argmax(1)
                p = np.where(letters, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0)
                label = [own.labels[b] if a else UNDETERMINED for a, b in zip(letters, best, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(label, pa.string()), pa.array(p, pa.float64())], [*kept, *out])

    return mapped(docs.select(*kept), score, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32(id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, by a model learnt from the rows that are not held out.

    A row with a null doc_id is neither held out nor learnt from. Null and empty texts, repeated rows, empty tables and long texts: as in predict(). Other columns are ignored, whatever their names.
    """
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, held_out, lang_pred, score."""
    return identify(table(spark, sf_dir, "documents"))
