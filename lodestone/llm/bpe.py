"""Byte-level BPE encoding and decoding.

Texts are split by the vocabulary's pattern. A word that is a token has its id. Any other is a string of units, one for each of its bytes, over which Spark's higher-order functions fold
the ranked merges: in the order of their ranks, each joins all pairs of its two units, left to right. What a merge makes ranks after its parts, so that this is what joining the pair of
the lowest rank again and again gives. The fold reads the merges from a literal map by rank; each word brings the ranks of the tokens that occur in it, since no other merge can apply. Words are folded
once for each batch of texts in which they are new; those that a sample of documents shows to be frequent, once altogether. Decoding concatenates the tokens' bytes.

A unit is an id as a character, moved past those that UTF-16 keeps for pairs.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batches, mapped, runs, table
from lodestone.llm.patterns import splitter

#: Documents that show which words are frequent, about (drawn by a hash of their text), and how many of their words are folded once for all. Both only save work.
SAMPLE_ROWS, FREQUENT = 24_000, 300_000
#: Text bytes of a pass: words that are new to it are folded.
PASS = 1 << 19
_GAP, _MOVE, _MOST = 0xD7FF, 0x800, 0xF000
_SEPARATOR = "\ufff0"  # no unit


def to_text(ids: np.ndarray) -> str:
    """Ids as a string of units: characters 1, 2, ... without surrogates."""
    ids = ids.astype(np.uint16)
    return (ids + np.uint16(1) + np.where(ids >= _GAP, np.uint16(_MOVE), np.uint16(0))).astype(">u2").tobytes().decode("utf-16-be")


def to_ids(text: str) -> np.ndarray:
    units = np.frombuffer(text.encode("utf-16-be"), ">u2").astype(np.uint16)
    return units - np.uint16(1) - np.where(units > _GAP, np.uint16(_MOVE), np.uint16(0))


class Vocabulary:
    """Ranks of a tiktoken file: all single bytes, and tokens that merges of two others make, ranked after them; ValueError for other files."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        if self.size > _MOST or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"not a byte-level vocabulary of at most {_MOST} tokens")

    def merges(self) -> dict[int, tuple[int, int]]:
        """By its id, the ids of the two tokens that each token of several bytes is made of."""
        out = {}
        for word, rank in self.ranks.items():
            if len(word) == 1:
                continue
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                near = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
                low = min(near)
                if low >= rank:
                    break
                i = near.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            out[rank] = pair = tuple(self.ranks[p] for p in parts)
            if len(pair) != 2 or any(r > rank for r, p in zip(pair, parts, strict=True) if len(p) > 1):
                raise ValueError(f"no ranked merge makes token {rank}")
        return out

    def literals(self) -> tuple[str, str]:
        """Of each rank the two units that its merge joins, and the one that it makes; empty where there is none."""
        merges = self.merges()
        joined = [to_text(np.array(merges[r])) if r in merges else "" for r in range(self.size)]
        return _SEPARATOR.join(joined), _SEPARATOR.join(to_text(np.arange(self.size)))

    @cached_property
    def _tokens(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, rank in self.ranks.items():
            if len(word) > 1:
                found.add_word(word.decode("latin-1"), rank)
        found.make_automaton()
        return found

    @cached_property
    def _byte_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.uint16)

    def prepared(self, words: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """Of each word the string of units of its bytes, and the ranks of the merges that may apply: those of tokens that occur in it, ascending."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        units = to_text(self._byte_ids[np.frombuffer(b"".join(words), np.uint8)])
        texts = pa.array([units[b - n : b] for b, n in zip(ends.tolist(), size.tolist(), strict=True)], pa.string())
        found = self._tokens.iter("\u0100".join(w.decode("latin-1") for w in words)) if words and len(self._tokens) else ()
        at, rank = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T
        each = np.sort(np.searchsorted(ends + np.arange(len(words)), at, side="left") << 16 | rank)
        each = each[np.append(True, each[1:] != each[:-1])] if len(each) else each
        return texts, pa.ListArray.from_arrays(pa.array(np.searchsorted(each >> 16, np.arange(len(words) + 1)), pa.int32()), pa.array(each & 0xFFFF, pa.int32()))

    def pieces(self) -> list[bytes]:
        out = [b""] * self.size
        for word, rank in self.ranks.items():
            out[rank] = word
        return out


def _bound(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(words: Column, merges: Column, literals: tuple[str, str]) -> Column:
    """words, arrays of strings of units, after their merges, arrays of ranks, in turn. literals: the rank map, bound once so that plans show it once."""
    joined, made = (F.split(F.lit(x), _SEPARATOR) for x in literals)  # constants, which the optimizer evaluates
    return _bound(joined, lambda a: _bound(made, lambda b: F.zip_with(words, merges, lambda w, m: F.aggregate(m, w, lambda s, rank: F.replace(s, F.get(a, rank), F.get(b, rank))))))


def _frequent(docs: DataFrame, total: int, vocabulary: Vocabulary, tokens, pattern: str, sample_rows: int, most: int, literals: tuple[str, str]) -> tuple[list[str], list[str]]:
    """Frequent words that are no tokens, and their units; at most `most`. tokens: the vocabulary, broadcast."""
    drawn = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(total, 1))))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, split = tokens.value.ranks, Counter(), splitter(pattern)
        for batch in batches(it, "text", PASS):
            seen.update(chain.from_iterable(map(split, batch["text"].to_pylist())))
        words = [w for w in seen if len(b := w.encode()) <= 64 and b not in own]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])

    def prepare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            units, merges = tokens.value.prepared([w.encode() for w in batch["word"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["word"], units, merges], ["word", "units", "merges"])

    words = mapped(drawn.select("text").filter("text is not null"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(most).select("word")
    ready = mapped(words.repartition(docs.sparkSession.sparkContext.defaultParallelism), prepare, "word string, units string, merges array<int>")
    got = ready.select("word", F.get(folded(F.array("units"), F.array("merges"), literals), F.lit(0)).alias("units")).toPandas()
    return got["word"].tolist(), got["units"].tolist()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, frequent: int = FREQUENT, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row; ids: little-endian unsigned 32-bit integers. No string of a text is a special token. decoded adds what decode() does, in the same pass.

    A null or empty text has no ids. Every row gives one, so null and repeated doc_ids stay; an empty table gives none. Texts are encoded whole, of any length; a
    single match of the pattern is held whole, at some ten times its bytes. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    literals, tokens = vocabulary.literals(), spark.sparkContext.broadcast(vocabulary)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words, word_units = _frequent(own, docs.count(), vocabulary, tokens, pattern, sample_rows, frequent, literals)
    listed = spark.sparkContext.broadcast(words)  # at most `frequent`
    lengths = np.array([1] * vocabulary.size + [len(u) for u in word_units], np.int32)
    flat = np.concatenate((np.arange(vocabulary.size, dtype=np.uint16), to_ids("".join(word_units))))
    known = spark.sparkContext.broadcast((lengths, np.cumsum(lengths, dtype=np.int64) - lengths, flat, vocabulary.pieces() if decoded else None))

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matches, new = tokens.value, splitter(pattern), []
        base = own.size + len(listed.value)

        class Codes(dict):
            def __missing__(self, word: str) -> int:
                self[word] = code = base + len(new)
                new.append(word)
                return code

        codes = Codes()
        for token, rank in own.ranks.items():
            try:
                codes[token.decode()] = rank
            except UnicodeDecodeError:
                pass  # no word of a text has such bytes
        codes.update(zip(listed.value, range(own.size, base), strict=True))
        for batch in batches(it, "text", PASS):
            lists = [matches(t) if t else [] for t in batch["text"].to_pylist()]
            counts = np.fromiter(map(len, lists), np.int32, len(lists))
            code = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int32, int(counts.sum()))
            for word in new:
                del codes[word]
            tail = own.prepared([w.encode() for w in new])
            new.clear()
            list_of = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([list_of(batch["doc_id"]), *(pa.array([x.tobytes()], pa.binary()) for x in (counts, code)), *map(list_of, tail)], ["docs", "counts", "codes", "tail", "merges"])

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts, flat, pieces = known.value
        for batch in it:
            for i in range(batch.num_rows):
                docs = batch["docs"][i].values
                counts, codes = (np.frombuffer(batch[c][i].as_buffer(), np.int32) for c in ("counts", "codes"))
                tail = batch["tail"][i].as_py()
                fresh = np.fromiter(map(len, tail), np.int32, len(tail))
                size, start = np.concatenate((lengths, fresh)), np.concatenate((starts, len(flat) + np.cumsum(fresh, dtype=np.int64) - fresh))
                every = np.concatenate((flat, to_ids("".join(tail))))
                n = size[codes].astype(np.int64)
                ids = every[runs(start[codes], n)].astype("<u4").tobytes()
                ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))] * 4
                own = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                arrays = [docs, pa.array(np.diff(ends) // 4, pa.int64()), pa.array(own, pa.binary())]
                if pieces:
                    arrays.append(pa.array([_text(x, pieces) for x in own], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decoded"][: len(arrays)])

    coded = mapped(own, split, "docs array<long>, counts binary, codes binary, tail array<string>, merges array<array<int>>")
    done = coded.select("docs", "counts", "codes", folded(F.col("tail"), F.col("merges"), literals).alias("tail"))
    return mapped(done, whole, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def _text(ids: bytes, pieces: list[bytes]) -> bytes:
    """The pieces of ids, concatenated."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the bytes of the tokens of its column ids, one after the other; null ids give null. Ids out of the vocabulary raise an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path).pieces())
    kept = [c for c in encoded.columns if c != "decoded"]

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        for batch in batches(it, "ids"):
            out = [None if x is None else _text(x, pieces) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(out, pa.binary())], [*kept, "decoded"])

    return mapped(encoded.select(*kept), join, encoded.select(*kept).schema.add("decoded", "binary"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
