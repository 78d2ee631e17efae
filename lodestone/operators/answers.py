"""Evidence as numbered passages, and what is made of generated answers: markers, citations, confidence, caveats."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.common import ranked
from lodestone.sources.staging import staged

UNTIED = "The answer could not be tied to specific passages."
EMPTY = "(no evidence retrieved)"


def render_evidence(evidence: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(query_id, rendered): passages (query_id, position, source, section, page_start, page_end, text, is_neighbor, seed_chunk_id) numbered in order, blank lines between. Of questions, those
    without a passage have a placeholder."""
    where = T.citation("source", "section", "page_start", "page_end")
    near = F.when(F.col("is_neighbor"), F.concat(F.lit("; adjacent context for "), "seed_chunk_id")).otherwise("")
    shown = evidence.select("query_id", "position", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] ("), where, near, F.lit(")\n"), "text").alias("shown"))
    listed = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "shown"))).alias("all"))
    rendered = listed.select("query_id", F.array_join(F.transform("all", lambda x: x["shown"]), "\n\n").alias("rendered"))
    return rendered if questions is None else questions.select("query_id").distinct().join(rendered, "query_id", "left").select("query_id", F.coalesce("rendered", F.lit(EMPTY)).alias("rendered"))


def finish_answers(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, used ARRAY<INT>, confidence, caveats, prefix, n) with markers, dropped, and final answer, confidence and caveats.

    Markers in the text that number a passage count; without any, the used ones that do. Others are dropped from the text. An answer tied to no passage has low confidence.
    """
    dropped = T.dropped_markers("answer", "n")
    inline = F.filter(T.markers("answer"), lambda m: m.between(1, F.col("n")))
    listed = F.filter(F.coalesce("used", F.array().cast("array<int>")), lambda m: m.between(1, F.col("n")))
    cited = F.when(F.size(inline) > 0, inline).otherwise(listed)
    rows = answers.withColumn("dropped", dropped).withColumn("markers", F.array_sort(F.array_distinct(cited)))
    said = T.strip(F.concat_ws(" ", F.nullif("prefix", F.lit("")), F.nullif("caveats", F.lit(""))))
    loose = F.size("markers") == 0
    return rows.select("query_id", T.strip(T.without_markers("answer", "n")).alias("answer"), "markers", "dropped", F.when(loose, "low").otherwise(F.col("confidence")).alias("confidence"), F.when(loose, T.strip(F.concat(said, F.lit(" " + UNTIED)))).otherwise(said).alias("caveats"))


def citations(finished: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each cited passage: (query_id, marker, chunk_id, source, section, pages, quote)."""
    cited = finished.select("query_id", F.explode("markers").alias("position"))
    return cited.join(evidence, ["query_id", "position"]).select("query_id", F.col("position").alias("marker"), "chunk_id", "source", "section", T.page_label("page_start", "page_end").alias("pages"), T.quote("text").alias("quote"))


class NoObject(ValueError):
    """A model's text holds no JSON object."""


def json_object(text: str) -> dict:
    """The JSON object of a model's text: thoughts and fences go, prose around it may stay."""
    text = re.sub(r"(?is)<think>.*?</think>", "", text).strip()
    fence = re.search(r"(?s)```(?:json)?\s*(.*?)```", text)
    text = fence[1].strip() if fence else text
    at = 0 if text.startswith(("[", '"')) else text.find("{")
    if at < 0:
        raise NoObject(text[:200])
    try:
        return json.JSONDecoder().raw_decode(text, at)[0]
    except json.JSONDecodeError as e:
        raise NoObject(str(e)) from e


_KINDS = {"string": str, "boolean": bool, "integer": int, "number": (int, float), "array": list, "object": dict}


class Invalid(ValueError):
    """A value is not as its schema says: the place, and what is wrong there."""

    def __init__(self, place: str, what: str):
        super().__init__(f"{place}: {what}")
        self.place, self.what = place, what


def validated(value: object, schema: dict, at: str = "answer") -> object:
    """value, if it is as a schema says (type, enum, properties, required, items); Invalid with the place where it isn't. Properties that the schema doesn't name are refused."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _KINDS[kind]) or isinstance(value, bool) != (kind == "boolean")):
        raise Invalid(at, f"is no {kind}")
    if "enum" in schema and value not in schema["enum"]:
        raise Invalid(at, f"is none of {', '.join(map(str, schema['enum']))}")
    if kind == "object":
        own = schema.get("properties", {})
        odd = [f"{k} is missing" for k in schema.get("required", own) if k not in value] + [f"{k} is unknown" for k in value if k not in own]
        if odd:
            raise Invalid(at, ", ".join(odd))
        for k, v in value.items():
            validated(v, own[k], f"{at}.{k}")
    for i, v in enumerate(value if kind == "array" else ()):
        validated(v, schema.get("items", {}), f"{at}[{i}]")
    return value


def structured(rows: DataFrame, schema: dict, text: str = "reply") -> DataFrame:
    """rows with what their model's text says: value, the JSON of an object as the schema wants it, or error and place, what is wrong with it and where. A null text has no object, one without an object has no place."""

    @F.pandas_udf("value string, error string, place string")
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for raw in texts:
            try:
                out.append((json.dumps(validated(json_object(raw or ""), schema), ensure_ascii=False), None, None))
            except Invalid as e:
                out.append((None, e.what, e.place))
            except NoObject:
                out.append((None, "no JSON object", None))
        return pd.DataFrame(out, columns=["value", "error", "place"])

    return rows.withColumn("_read", read(F.col(text))).select("*", "_read.value", "_read.error", "_read.place").drop("_read")


def ask_structured(rows: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], schema: dict) -> DataFrame:
    """(key, value, error, place, attempts) of rows: what ask(), from rows to (key, reply), says of each. Rows whose reply doesn't hold, and no others, are asked once more, with its error and place as columns for the model to
    mend. Rows without a reply have the error `no reply`; of several replies the first that holds counts, then the smallest."""

    def replied(asked: DataFrame) -> DataFrame:
        told = structured(ask(asked).select(key, "reply"), schema)
        one = ranked(told, [key], [F.col("value").isNull(), "value", "error", "place"], "_at").filter("_at = 1").select(key, "value", "error", "place")
        return asked.select(key).join(one, key, "left").withColumn("error", F.when(F.col("value").isNull(), F.coalesce("error", F.lit("no reply"))))

    first = staged(replied(rows))
    open_ = rows.join(first.filter("value is null").select(key, "error", "place"), key)
    second = replied(open_).withColumn("attempts", F.lit(2))
    return first.filter("value is not null").withColumn("attempts", F.lit(1)).unionByName(second)
