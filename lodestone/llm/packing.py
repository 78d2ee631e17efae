"""Best-fit packing of token sequences by large-item matching.

Pieces over a third of the capacity stand at most two to a sequence, paired greedily, the longest with the longest
that still fits; shorter pieces then go, longest first, to the sequence whose gap they fill best. The plan depends on
nothing but how many pieces have each length, so the driver makes it from a histogram of at most `capacity` rows, and
the pieces are dealt to the planned places by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import batches, mapped, table, written
from lodestone.llm.patterns import PATTERN, UNCOMMON

CAPACITY, END_ID = 1024, 2
#: Characters of white space in a row, at twice which at the latest a text goes to the library itself.
BLANKS = 500
#: Pieces of one length and salt that one task ranks.
RANKED = 500

@lru_cache(maxsize=1)  # a worker's tasks share it
def tokenizer_ids(path: str) -> Callable[[str], list[int]]:
    """Function from a text to its ids by the tokenizers library, without special tokens added; a special token's string in a text is that token.

    Where the file says that texts are split by PATTERN alone and merged by rank, the same merges run in another library, which is several times faster; texts with uncommon characters, with strings of added
    tokens or with very long white space, and all texts for other files, go to the library itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    merged = _ranked_merges(own)
    if merged is None:
        return lambda text: own.encode(text, add_special_tokens=False).ids
    added = [t.content for t in own.get_added_tokens_decoder().values()]

    def ids(text: str) -> list[int]:
        if UNCOMMON.search(text) or any(t in text for t in added) or any(text[i : i + BLANKS].isspace() for i in range(0, len(text) - BLANKS, BLANKS)):
            return own.encode(text, add_special_tokens=False).ids
        return merged(text)

    return ids


def _ranked_merges(own) -> Callable[[str], list[int]] | None:
    """The encoding of texts of common characters by ranks, or None where that could differ from the library's.

    The library joins the pairs of its list of merges, the other one any two tokens that make a third, both those of the lowest rank first. They differ only if some token's own bytes don't end as
    that token: with all merges below its rank done, what stands in its place anywhere is what its bytes alone give. So every token is tried.
    """
    told = json.loads(own.to_str())
    split, model = told["pre_tokenizer"] or {}, told["model"]
    plain = not any(told.get(k) for k in ("normalizer", "truncation", "padding")) and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves in the vocabulary, others for characters from 256
    byte_of = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - itself))}
    added = {t.content for t in own.get_added_tokens_decoder().values()}
    tokens = {t: i for t, i in model["vocab"].items() if t not in added}
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    ordered = None not in made and all(a < b for a, b in zip(made, made[1:], strict=False))
    if not ordered or any(c not in tokens for c in byte_of) or any(not set(t) <= byte_of.keys() for t in tokens) or any([x.id for x in own.model.tokenize(t)] != [i] for t, i in tokens.items()):
        return None
    import tiktoken

    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in tokens.items()}
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, uid) of each row of docs.

    A row's ids are those of its text (null: of no text), then end_id. Over capacity they are cut into pieces of
    capacity ids, of which the first may be shorter. uid: unique number of the piece in this table, once written.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = tokenizer_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 33
        for batch in batches(it, "text"):
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = array("I", ids(text) if text else ()).tobytes() + end
                n = len(own) // 4
                first = n % capacity or capacity
                at = 0
                for k in range(-(-n // capacity)):
                    length = capacity if k else first
                    rows.append((doc, k, at, length, zlib.crc32(own[4 * at : 4 * (at + length)]), uid))
                    at, uid = at + length, uid + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places (length, low, high, first sequence, offset): the pieces of that length ranked low to high - 1 go to consecutive sequences.

    counts: how many pieces have each length. The number of rows grows with the number of lengths, not of pieces.
    """
    left = {n: k for n, k in counts.items() if k > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("a length is not within 1 and the capacity")
    groups: list[tuple[list[int], int]] = []  # lengths in order, number of sequences
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left.get(n, 0):
            mate = next((m for m in large if m <= n and m <= capacity - n and left.get(m, 0) > (m == n)), None)
            if mate is None:
                groups.append(([n], left.pop(n)))
                break
            k = left[n] // 2 if mate == n else min(left[n], left[mate])
            groups.append(([n, mate], k))
            left[n] -= k
            left[mate] -= k
    open_gaps: list[tuple[int, int]] = sorted((capacity - sum(own), i) for i, (own, _) in enumerate(groups))
    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        many = left[n]
        while many:
            at = bisect.bisect_left(open_gaps, (n, -1))
            if at == len(open_gaps):
                groups.append(([], -(-many // (capacity // n))))
                gap, i = capacity, len(groups) - 1
            else:
                gap, i = open_gaps.pop(at)
            own, size = groups[i]
            each = min(gap // n, many)
            k = min(size, many // each)
            if k < size:  # the others of the group keep their gap
                groups.append((own, size - k))
                bisect.insort(open_gaps, (gap, len(groups) - 1))
            groups[i] = (own + [n] * each, k)
            many -= k * each
            bisect.insort(open_gaps, (gap - n * each, i))
    places, base, ranks = [], 0, dict.fromkeys(counts, 0)
    for own, size in groups:
        offset = 0
        for n in own if size else []:
            places.append((n, ranks[n], ranks[n] + size, base, offset))
            ranks[n] += size
            offset += n
        base += size
    return places


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (a written table of pieces) with sequence_id and offset: one row for each piece.

    Full pieces are sequences of their own. Others are ranked within their length in salted parts, so that a length that
    many pieces have is spread over tasks; the plan that is broadcast has some rows for each length below capacity.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    full = found.filter(F.col("length") == capacity).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("uid")
    counts.pop(capacity, None)
    places = spark.createDataFrame(plan(counts, capacity), "size long, low long, high long, base long, offset long")
    salts = min(1 << 16, 1 + max(counts.values(), default=0) // RANKED)
    part = found.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    sums = part.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = part.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("at", F.col("at") + F.col("before"))
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("size")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    rest = placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at") - F.col("low")).alias("sequence_id"), "offset")
    return rest.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as packed sequences of at most `capacity` ids: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Every row of docs is a document, also where doc_ids are null or repeat: each gives its own pieces. A null or empty
    text has the end id alone. Texts of any length are cut, none dropped. Equal lengths are placed in the order of an
    internal number. An empty table gives no rows; other columns are ignored.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
