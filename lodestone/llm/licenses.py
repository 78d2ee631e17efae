"""License scans by an exact set-similarity join, in DataFrame operations only.

A text block is a run of consecutive words, a quarter longer than the template it is held against, so that wrapped lines and words put in do no harm; a template is contained in it if at least a threshold
of its distinct words are there. All words of templates are ordered by the number of documents in the whole table that have them, rarest first. A block with enough of a template's
words has one of its rarest ones, so candidates come from a join on those (prefix filter); the stretch of words around has to have as many template words as the overlap asks for (length filter), and as many
from that word on in the common order (positional filter). What passes is confirmed on all its blocks. Beside it, base phrases are found where their words stand consecutively.

Texts are read once: that gives counts, base phrases and the template words of each document, and of documents with enough words of some template their words, which are few.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, written

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Statements by which well-known licenses are granted, and their full notices, with labels for them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Share of a template's distinct words that a block must have.
THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters of no word.
GAPS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and a blank for each character of no word: words() of it then needs no regular expression."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))


def words(low: Column) -> Column:
    return F.array_remove(F.split(low, " "), "")


def template_sets(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, str, list[str], int, int]]:
    """Of each template its number, label, distinct words, how many of them a block needs, and how many words a block has."""
    out = []
    for i, (label, text) in enumerate(templates):
        w = re.findall(WORD, text.lower())
        own = sorted(set(w))
        out.append((i, label, own, max(1, math.ceil(len(own) * threshold - 1e-9)), len(w) + -(-len(w) // 4)))
    return out


def _read(own: DataFrame, phrases, sets) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, known, w) of own (doc_id, low): counts, base phrases and their labels, the template words that occur, and all words where some template has
    enough of those."""
    w, vocabulary = F.col("w"), sorted({x for _, _, s, _, _ in sets for x in s})

    def starts(phrase: str) -> Column:
        parts = phrase.split()

        def here(i: Column) -> Column:
            return functools.reduce(operator.and_, (F.get(w, i + k) == p for k, p in enumerate(parts)))

        return F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), here)

    likely = {p: functools.reduce(operator.and_, (F.col("low").contains(x) for x in p.split())) for p, _ in phrases}
    none = F.array().cast("array<int>")
    out = own.select("doc_id", "low", words(F.col("low")).alias("w"))
    known = F.array_intersect(F.array(*map(F.lit, vocabulary)), w)
    out = out.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), known.alias("known"), *(F.when(likely[p], starts(p)).otherwise(none).alias(f"at{i}") for i, (p, _) in enumerate(phrases)))
    places = F.concat(*(f"at{i}" for i in range(len(phrases))))
    labels = F.filter(F.array(*(F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())
    enough = functools.reduce(operator.or_, (F.size(F.array_intersect(F.array(*map(F.lit, s)), "known")) >= need for _, _, s, need, _ in sets), F.lit(False))
    least = min((need for _, _, _, need, _ in sets), default=1)
    out = out.select("doc_id", "n_words", places.alias("places"), labels.alias("base"), "known", F.when((F.size("known") >= least) & enough, w).alias("w"))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), "base", "known", "w")


def matches(read: DataFrame, sets) -> DataFrame:
    """(row, found, best): labels of the templates that some block of the document contains, and the largest containment. read: row, known, w."""
    spark = read.sparkSession
    counted = read.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = {r["word"]: r["n"] for r in counted.collect()}  # at most as many rows as the templates have words
    order = sorted({x for _, _, s, _, _ in sets for x in s}, key=lambda x: (often.get(x, 0), x))
    rank = {x: i for i, x in enumerate(order)}
    index = []
    for i, label, s, need, length in sets:
        by_rank = sorted(s, key=rank.__getitem__)
        index += [(x, i, label, place, len(s), need, length, by_rank) for place, x in enumerate(by_rank[: len(s) - need + 1])]
    lists = spark.createDataFrame(index, "word string, template int, label string, place int, size int, need int, length int, words array<string>")
    prefix = sorted({row[0] for row in index})
    probes = read.filter("w is not null").select("row", "w", F.posexplode("w").alias("at", "word")).filter(F.col("word").isin(prefix))
    # the words that blocks with this one have, from the start of the first to the end of the last
    first = F.greatest(F.col("at") - F.col("length") + 1, F.lit(0))
    near = probes.join(F.broadcast(lists), "word").select("*", F.slice("w", first + 1, F.col("at") - first + F.col("length")).alias("around"))
    own = F.array_intersect(F.array(*map(F.lit, order)), F.col("around"))
    near = near.drop("w").withColumn("own", own).withColumn("from", F.array_position("own", F.col("word")).cast("int") - 1)
    near = near.filter(F.size("own") >= F.col("need")).filter(F.least(F.col("size") - F.col("place"), F.size("own") - F.col("from")) >= F.col("need") - F.least("place", "from"))
    # of all blocks, those that begin with a template word have most of them
    begins = F.filter(F.sequence(F.lit(0), F.size("around") - 1), lambda i: F.array_contains("words", F.get("around", i)))
    common = F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect("words", F.slice("around", i + 1, F.col("length"))))))
    sure = near.select("row", "label", "size", "need", common.alias("common")).filter("common >= need")
    return sure.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("best"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs.

    score: 1 where a base phrase stands, else the largest containment among the templates found, else 0. A null or empty text has no words: counts of 0, null places,
    empty labels. Every row is a document of its own, also where doc_ids are null or repeat; an empty table gives no rows. Texts of any length are read whole. Other columns are ignored, whatever their names.
    """
    sets = template_sets(templates, threshold)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), lowered(F.col(text_col).cast("string")).alias("low"))
    read = written(_read(own, phrases, sets).select(F.monotonically_increasing_id().alias("row"), "*"), "licenses")
    both = read.join(matches(read, sets), "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def oracle() -> str:
    """DuckDB SQL for op5_license_scan: every template against the blocks that begin with one of its words, without filters; no other block has more of them."""
    hits = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        here = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        hits.append(f"select r, i as place, '{label}' as label from (select r, w, unnest(range(0, greatest(len(w) - {len(parts) - 1}, 0))) as i from words) where {here}")
    templates = " union all ".join(f"select {i}, '{label}', {len(s)}, {need}, {length}, unnest({_quoted(s)})" for i, label, s, need, length in template_sets())
    return f"""
with own as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as low from documents),
words as (select r, doc_id, regexp_extract_all(low, '{WORD}') as w from own),
hits as ({" union all ".join(hits)}),
base as (select r, count(*) as n, min(place) as lo, max(place) as hi, list_distinct(list(label)) as labels from hits group by r),
t(template, label, size, need, length, word) as ({templates}),
p as (select r, i, word from (select r, unnest(w) as word, generate_subscripts(w, 1) as i from words) where word in (select word from t)),
o as (select r, i, word, template, label, size, need, length from p join t using (word)),
blocks as (select a.r, a.template, a.i, any_value(a.label) as label, any_value(a.size) as size, any_value(a.need) as need, count(distinct b.word) as common
  from o a join o b on a.r = b.r and a.template = b.template and b.i >= a.i and b.i < a.i + a.length group by a.r, a.template, a.i),
found as (select r, list_distinct(list(label)) as labels, max(common / size) as best from blocks where common >= need group by r)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, base.lo::bigint as first_word, base.hi::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []::varchar[]), coalesce(found.labels, []::varchar[])))), ','), '') as labels,
  case when base.n > 0 then 1.0::double else coalesce(found.best, 0)::double end as score
from words w left join base using (r) left join found using (r)"""
