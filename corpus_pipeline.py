"""A corpus pipeline of five stages; each takes all its predecessor kept, and what it decides takes effect in what it returns.

language (rejected documents go), quality (rejected documents go), near_dedup (one document of each group stays), substrings (words of
repeated passages go), packing (documents become sequences). All but the last return the columns of documents.

Every stage reads documents whole, however long, and gives an empty table for an empty one. Every row is a document of its own, also where doc_ids are null or repeat and where rows are equal;
nulls in other columns stay. Documents may have further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language as _language
from lodestone.llm import minhash, packing, quality, substrings
from lodestone.llm.common import cleared, made, table, with_key, written

#: A document is rejected if its language is undetermined or less likely than this.
LEAST_LANGUAGE = 0.5
#: Near duplicates share this percentage of the union of their shingles of so many words; 32 bands find such a pair with probability 1 - 3e-6.
PERCENT, SHINGLE, BANDS = 80, 5, 32

#: No SQL gives run()'s rows: classifiers are fitted and tokens counted on the way.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language, learned from those that name theirs, is told with LEAST_LANGUAGE or more; a null or empty text, or one without letters, is rejected, and so is all if no document names one."""
    model = _language.fit(docs)
    names = _new(docs, "_language", "_likely")
    found = _language.predict(docs, model, out=names)
    return found.filter((F.col(names[0]) != _language.UNDETERMINED) & (F.col(names[1]) >= LEAST_LANGUAGE)).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on docs and the table of labels, takes for good; null and empty texts are rejected. Without labels of both kinds all others stay. The columns lang and source may be null."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    clash = [c for c in docs.columns if c in quality.SCORES]
    moved = dict(zip(clash, _new(docs, *(f"_{c}" for c in clash)), strict=True))
    judged = quality.score(docs.withColumnsRenamed(moved), model).filter("quality_kept")
    return judged.select([F.col(moved.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; texts without words are in no group and stay."""
    keyed, key = with_key(docs, "doc_id")
    found = minhash.near_duplicates(keyed, PERCENT, SHINGLE, BANDS, id_col=key)
    return keyed.join(found.filter("not kept").select(F.col("doc_id").alias(key)), key, "left_anti").select(docs.columns)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stand elsewhere too; where words go, the others are joined by one blank and n_chars, if there, is counted anew. A document of which nothing is left stays, empty."""
    keyed, key = with_key(docs, "doc_id")
    cut = substrings.remove_repeats(keyed, id_col=key).filter("n_removed > 0")
    left = _new(keyed, "_kept")[0]
    both = keyed.join(cut.select(F.col("doc_id").alias(key), F.col("kept").alias(left)), key, "left")
    changed = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(left).isNotNull(), F.length(left).cast("long")).otherwise(F.col("n_chars"))
    return both.select([changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end id."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _new(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of docs has."""
    out = []
    for name in names:
        while name in docs.columns:
            name += "_"
        out.append(name)
    return tuple(out)


STAGES = [("language", language), ("quality", quality_stage), ("near_dedup", near_dedup), ("substrings", substrings_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each but the last is written; what it has written on its way, and what it read, is deleted then."""
    docs, since = table(spark, sf_dir, "documents"), made(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        cleared(spark, since, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
