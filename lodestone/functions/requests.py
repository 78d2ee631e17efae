"""What a service in front of the engine checks, shows and logs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

MOST_CHARACTERS, MOST_BYTES = 4_000, 65_536


def verdict(body: Column, question: Column) -> Column:
    """The status code of a request: 413 for too large a body, 400 for an empty or too long question, else 200."""
    plain = T.strip(F.coalesce(question, F.lit("")))
    return F.when(F.octet_length(body) > MOST_BYTES, 413).when((plain == "") | (F.length(plain) > MOST_CHARACTERS), 400).otherwise(200)


def public(states: DataFrame) -> DataFrame:
    """Of a finished state, what a client sees."""
    return states.select("query_id", "status", "response", "confidence", "caveats", "citations")


def logged(value: Column, show: bool, most: int = 2_000) -> Column:
    """A payload for the log: cut, or replaced by its size where payloads are not to be shown."""
    return T.compact(value, most) if show else F.concat(F.lit("<"), F.length(value).cast("string"), F.lit(" chars>"))


def event(name: str, **fields: Column) -> Column:
    """A log line of key=value pairs."""
    return F.concat_ws(" ", F.lit(name), *(F.concat(F.lit(f"{k}="), F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("v")))) - 6)) for k, v in fields.items()))


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """(query_id, evidence): a log line's view of passages, without their texts."""
    one = F.struct("position", "chunk_id", "source", "section", T.page_label("page_start", "page_end").alias("pages"), "rerank_score", "is_neighbor")
    return evidence.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("evidence"))
