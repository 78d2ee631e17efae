"""The corpus operators against brute force, exact round trips and held-out accuracy, and on hostile tables."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, common, graph, html, language, licenses, minhash, packing, quality, queries, search, substrings, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def united(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- components ---


@pytest.mark.parametrize("seed, few", [(0, 0), (0, 1000), (1, 1000), (2, 1000)])
def test_components(spark, seed, few):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == united({x for e in edges for x in e}, edges)


def test_no_components(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_are_cleared(spark):
    import os

    from lodestone.llm import common

    path = common.written(spark.range(3), "x")._lodestone_path
    assert os.path.isdir(path)
    common.cleared(spark)
    assert not os.path.exists(path) and not common.made(spark)


# --- near duplicates ---


def shingles(text, size=3):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_copies(rows, percent=85, size=3):
    sets = {i: shingles(t, size) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, united(sets, links)


def test_minhash_equals_brute_force(docs, rows):
    sets, comps = near_copies(rows)
    got = by_id(minhash.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), comps[i], comps[i] == i) for i in sets}
    assert len(set(comps.values())) < len(rows) - 5


def test_minhash_on_a_family_around_the_threshold(spark):
    """Copies of one text that differ so much that some pairs link and others don't: stars alone would lose links."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rnd.randint(1, 6)):
            own[rnd.randrange(len(own))] = rnd.choice(["p", "q", f"u{i}"])
        rows.append((i, " ".join(own)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    _, comps = near_copies(rows)
    assert {i: r["component_id"] for i, r in got.items()} == comps and 1 < len(set(comps.values())) < 90


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    b = np.concatenate((a[:240], rng.integers(0, 1 << 62, 60, dtype=np.uint64)))
    few = a[:5]  # most bins are borrowed
    owner = np.repeat([0, 1, 2, 3], [300, 300, 5, 5])
    sig = minhash.signatures(owner, np.concatenate((np.sort(a), np.sort(b), np.sort(few), np.sort(few))), 4, 2000)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.06 and (sig[2] == sig[3]).all()


# --- search ---


def test_search_equals_sql(spark, docs, rows):
    asked = [(0, " ".join(rows[3][1].split()[:8])), (1, "tala KONE"), (2, None), (3, "nowhere"), (4, rows[20][1]), (None, "tala")]
    queries_ = spark.createDataFrame(asked, "item_id long, text string")
    index = search.build_index(docs, shard_bytes=3000).cache()
    assert index.count() > 3
    got = sorted(tuple(r) for r in search.search(index, queries_).select("query_id", "rank", "doc_id", "score").collect())
    duck = duckdb.connect()
    documents, benchmark = docs.toPandas(), queries_.filter("item_id is not null").toPandas()  # noqa: F841  read by name
    duck.register("documents", documents[["doc_id", "text"]])
    duck.register("benchmark", benchmark)
    want = sorted(duck.sql("select query_id, rank, doc_id, score from (" + search.ORACLE + ")").fetchall())
    assert [g[:3] for g in got] == [tuple(map(int, w[:3])) for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("name", ["op2_bm25_top_k", "op11_wand_search"])
def test_tasks_hold_few_shards_of_an_index(spark, docs, tmp_path, monkeypatch, name):
    """a row group had a hundred shards of some five MB or all those of its file, and writers and readers hold a whole one."""
    import __spark_entry__
    from lodestone.llm import common, wand

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "tala kone")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    build, write, paths = search.build_index, common.written, []

    def written(df, *a):
        out = write(df, *a)
        paths.append(out._lodestone_path)
        return out

    for module in (search, wand):
        monkeypatch.setattr(module, "build_index", lambda d: build(d, shard_bytes=300))
    monkeypatch.setattr(search, "written", written)
    rows = __spark_entry__.queries()[name](spark, str(tmp_path)).count()
    groups = [m.row_group(i).num_rows for f in glob.glob(f"{next(p for p in paths if '/index-' in p)}/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert rows and len(groups) > 5 and max(groups) <= search.GROUP


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_corpus_search_equals_sql(spark):
    """Every document whose id is divisible by 50 is a query."""
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in __spark_entry__.queries()["op2_bm25_corpus_top_k"](spark, sf).select("query_id", "rank", "doc_id", "score").collect())
    assert {g[0] for g in got} == {0, 50, 100, 150}
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(duck.sql("select query_id, rank, doc_id, score from (" + __spark_entry__.oracle_sql()["op2_bm25_corpus_top_k"] + ")").fetchall())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_search_prunes_without_loss():
    """Long lists, so that ranges of documents are skipped by their block maxima."""
    rng = np.random.default_rng(2)
    n = 4000
    terms = [rng.integers(0, 30, rng.integers(5, 60)) for _ in range(n)]
    terms[777] = np.arange(30).repeat(2)
    doc = np.repeat(np.arange(n), [len(t) for t in terms])
    term = np.concatenate(terms).astype(np.uint64)
    own = search._shard(np.arange(n), *search._summed(doc, term, np.ones(len(term), int)))
    x = {c: own[c].astype(k) for c, k in search._COLUMNS}
    asked, idf = np.array([2, 5, 11, 29], np.uint64), np.array([1.0, 3.0, 0.5, 2.0])
    mean = len(term) / n
    d, s = search._best(x, asked, idf, mean, 10, 1.2, 0.75)
    best = sorted(zip(-np.round(s, 6), d, strict=True))[:10]
    every = []
    for i, t in enumerate(terms):
        c = Counter(t.tolist())
        score = sum(w * c[int(q)] * 2.2 / (c[int(q)] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for q, w in zip(asked, idf, strict=True))
        if score > 0:
            every.append((-round(score, 6), i))
    assert [b[1] for b in best] == [e[1] for e in sorted(every)[:10]]


# --- byte-level BPE ---


def test_bpe_equals_tiktoken(docs, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.Vocabulary(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    got = by_id(bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, frequent=40), path))
    at_once = by_id(bpe.encode(docs, path, public_tokenizers.PATTERN, frequent=40, decoded=True))
    assert all(tuple(at_once[i]) == tuple(r) for i, r in got.items())
    for i, text, *_ in rows:
        want = enc.encode_ordinary(text or "")
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want and got[i]["n_tokens"] == len(want) and bytes(got[i]["decoded"]) == (text or "").encode()


def test_long_words_equal_library(spark):
    """Words of any length go through the fold."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(path).ranks, special_tokens={})
    rnd = random.Random(2)
    texts = ["abc" * 900, "é" * 1500, "Wörterbuch" * 300, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "漢字" * 3000, "a" * 5000]
    got = by_id(bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.PATTERN, decoded=True))
    for i, text in enumerate(texts):
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == enc.encode_ordinary(text) and bytes(got[i]["decoded"]) == text.encode()


@pytest.mark.parametrize("pattern", [r"\w+|\W+", r"\p{L}{1,3}|[^\p{L}]+"])
def test_the_pattern_given_is_used(docs, rows, pattern):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Vocabulary(path).ranks, special_tokens={})
    got = by_id(bpe.encode(docs.filter("doc_id % 3 = 0"), path, pattern, frequent=10))
    assert all(np.frombuffer(got[i]["ids"], "<u4").tolist() == enc.encode_ordinary(t or "") for i, t, *_ in rows if i % 3 == 0)


def test_units_are_characters():
    ids = np.arange(bpe._MOST, dtype=np.uint16)
    text = bpe.to_text(ids)
    assert (bpe.to_ids(text) == ids).all() and sorted(text) == list(text) and bpe._SEPARATOR not in text and len(text.encode()) > 0


def test_other_vocabularies_are_refused(tmp_path):
    import base64

    lines = [bytes([b]) for b in range(256)] + [b"abc"]  # no merge makes it
    path = tmp_path / "v"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(lines)))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(path)).merges()


# --- quality ---


def junk(i, rnd):
    words = ["tala", "kone", "ripo", "muzu"]
    text = " ".join(rnd.choice(words) for _ in range(60))
    return text.upper().replace(" ", "!! ") if i % 2 else (rnd.choice(words) + " ") * 60


def test_cotraining_on_rows_kept_apart(spark):
    rnd = random.Random(4)
    stems = [a + b for a in ("ta", "ko", "ri", "mu", "se") for b in ("la", "ne", "po", "zu", "st")]
    docs_, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.3
        docs_.append((i, junk(i, rnd) if bad else " ".join(rnd.choice(stems) for _ in range(rnd.randint(20, 120))), "xx", f"s{int(bad) if rnd.random() < 0.7 else rnd.randint(0, 1)}"))
        labels.append((i, int(not bad)))
    docs_ = spark.createDataFrame(docs_, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels[:200] + [(i, None) for i in range(200, 220)], "doc_id long, quality int")
    got = by_id(quality.classify(docs_, known))
    right = [got[i]["quality_kept"] == bool(q) for i, q in labels[200:]]
    assert sum(right) / len(right) > 0.95 and all(0 <= r["quality_score"] <= 1 for r in got.values())


def test_quality_without_labels(spark, docs):
    got = by_id(quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert all(r["quality_score"] == 1.0 for i, r in got.items() if r["quality_kept"]) and sum(not r["quality_kept"] for r in got.values()) == 2


# --- licenses ---


def license_rows():
    lines = [
        "Licensed under CC BY-NC 4.0.", "cc, BY", "accby", "cc byx", "General public  License! general PUBLIC license", "All Rights\nReserved", "all rights reservedé", "Licensed under the Apache License, Version 2.0",
        "version 2 0 the apache under license: licensed", "Released under MIT License", "Released under the MIT License and more", "REDISTRIBUTION and use in source and binary forms, with or without modification, are permitted provided that the following conditions are", "",
    ]
    rows = [(i, x) for i, x in enumerate(lines)] + [(50, "\n".join(lines)), (51, None), (52, "the of " * 500 + "under the license"), (53, " ".join(lines))]
    return rows


def test_license_scan_equals_sql(spark):
    got = spark.createDataFrame(license_rows(), "doc_id long, text string")
    duck = duckdb.connect()
    duck.register("documents", got.toPandas())
    mine = sorted(tuple(r) for r in licenses.scan_licenses(got).collect())
    theirs = sorted(duck.sql(licenses.oracle()).fetchall())
    assert mine == theirs
    assert {r[0]: r[5] for r in mine}[4] == "gpl" and {r[0]: r[6] for r in mine}[8] == "apache-2.0" and {r[0]: r[6] for r in mine}[9] == ""


def test_license_plan_has_no_python(spark):
    plan = licenses.scan_licenses(spark.createDataFrame(license_rows(), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- embeddings ---


def vector_rows():
    rng = np.random.default_rng(6)
    rows, at = [], 0
    for label in (0, 1, None):
        for size in (1, 3, 40):
            for _ in range(4):
                centre = rng.standard_normal(16)
                for _ in range(size):
                    v = centre + rng.standard_normal(16) * 0.02
                    rows.append((at, [float(x) for x in np.float32(v * rng.uniform(0.1, 9))], label))
                    at += 1
    rows += [(at, rows[5][1], 0), (at + 1, rows[5][1], 1), (at + 2, [0.0] * 16, 0), (at + 3, None, 0), (at + 4, [None] + [1.0] * 15, 0), (at + 5, [math.nan] + [1.0] * 15, 0), (at + 6, [math.inf] + [1.0] * 15, 0), (at + 7, [], 0), (at + 8, rows[5][1][:8], 0), (at + 9, [1e300 * x for x in rows[5][1]], 0)]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "SORTED", 300)
    monkeypatch.setattr(vectors.link_counts, "__defaults__", (0.98, block))
    rows = vector_rows()
    got = by_id(vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=16), "vec_id")
    good = {i: np.array(v) / np.abs(v).max() for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and cos(good[a], good[b]) >= 0.98]
    n = Counter(x for e in links for x in e)
    comps = united([r[0] for r in rows], links)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], comps[i], comps[i] == i) for i in comps}


# --- language ---


def test_language_on_held_out_rows(spark):
    rnd = random.Random(8)
    sounds = {"aa": "kalomeri", "bb": "strunghe", "cc": "çéàçêio"}
    rows = []
    for i in range(900):
        lang = rnd.choice(list(sounds))
        rows.append((i, " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(1, 40))), lang if i % 11 else None))
    rows += [(1000, None, "aa"), (1001, "12 !?", "aa"), (1002, "", None), (None, rows[0][1], "aa")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    named = {r["doc_id"]: r for r in got}
    assert all(named[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows if i is not None) and named[None]["held_out"] is False
    apart = [named[i]["lang_pred"] == lang for i, t, lang in rows if lang and i is not None and i < 1000 and named[i]["held_out"]]
    assert sum(apart) / len(apart) > 0.97
    assert all(named[i]["lang_pred"] == "und" and named[i]["score"] == 0 for i in (1000, 1001, 1002)) and all(0 <= r["score"] <= 1 for r in got)


def test_language_never_uses_the_rows_own_label(spark):
    rows = [(i, "kalo meri" if i % 2 else "strung he", "aa" if i % 2 else "bb") for i in range(60)]
    one = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out").collect()
    two = language.identify(spark.createDataFrame([(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "zz") for i, t, lang in rows], "doc_id long, text string, lang string")).filter("held_out").collect()
    assert sorted(one) == sorted(two)


def test_long_texts_are_scored_whole(monkeypatch):
    texts = ["ab" * 700 + " é x", "q", "", "12 " * 400 + "z"]
    count = lambda: [np.bincount(o * 97 + b, minlength=4 * 97) for o, b, _ in [tuple(np.concatenate(x) for x in zip(*language.grams(texts, 97), strict=True))]][0]
    whole = count()
    monkeypatch.setattr(language, "_PIECE", 50)
    assert (count() == whole).all()


# --- substrings ---


def removed_slowly(rows, window):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    seen = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("window", [4, 5, 12, 35])
def test_substrings_equal_brute_force(docs, rows, window):
    want = removed_slowly(rows, window)
    got = by_id(substrings.remove_repeats(docs, window))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(got[i]["kept"] == w[3] for i, w in want.items() if w[1])


def test_repeats_within_one_document(spark):
    rows = [(1, "a b a b a b a b a b x y"), (2, "c " * 30)]
    got = by_id(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 4))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: w[:3] for i, w in removed_slowly(rows, 4).items()}


def test_texts_and_picks_without_repeats_are_not_shuffled_again(spark, monkeypatch):
    """All texts were shuffled to meet the few that have repeats, and all picks for each of two levels."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(400)]
    rows[7] = (7, "other " + rows[3][1])
    plans, texts = [], []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.written(df, name)

    def counted(df, keys, column):
        texts.append(sorted(r[column] for r in common.among(df, keys, column).collect()))
        return common.among(df, keys, column)

    monkeypatch.setattr(substrings, "written", noted)
    monkeypatch.setattr(substrings, "among", counted, raising=False)
    got = by_id(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: w[:3] for i, w in removed_slowly(rows, 35).items()}
    assert len(texts) == 1 and {3, 7} <= set(texts[0]) and len(texts[0]) < 150
    assert sum("seeds" in p for name, p in plans if name != "windows") == 2 and "bit_or" in dict(plans)["held"]


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_no_row_is_lost_among_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    keys = spark.range(-300, 300, 6).withColumnRenamed("id", "k")
    rows = spark.createDataFrame([(i, str(i)) for i in range(-500, 500)] + [(None, "x")], "k long, t string")
    got = {r["k"] for r in common.among(rows, keys, "k").collect()} - {None}
    assert set(range(-300, 300, 6)) <= got and len(got) < (1000 if bits == 64 else 330)
    assert common.among(rows, keys.limit(0), "k").count() == 0 and common.among(rows, keys, "k").columns == ["k", "t"]


# --- pages ---

def test_copies_of_vectors_do_not_fill_the_window(spark):
    """Pairs of one topic, each vector 40 times: other vectors' copies come between the two of a pair."""
    rng = np.random.default_rng(9)
    one = rng.standard_normal((100, 64)) * 0.3 + rng.standard_normal(64)
    both = np.concatenate((one, one + rng.standard_normal((100, 64)) * 0.085))
    which = rng.permutation(np.repeat(np.arange(200), 40))
    rows = [(i, [float(x) for x in both[w]], 0) for i, w in enumerate(which)]
    got = by_id(vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=16), "vec_id")
    unit = both / np.linalg.norm(both, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    first = {w: i for i, w in reversed(list(enumerate(which.tolist())))}
    comps = united([*first.values()], [(first[a], first[b]) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if a != b])
    assert (near.sum() - 200) // 2 == len(set(comps.values())) == 100
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (int(near[w].sum()) * 40 - 1, comps[first[w]]) for i, w in enumerate(which.tolist())}


PAGE = """<html><head><title>T &amp; t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies to make this very long notice even longer than it needs to be, really.</p></div><nav><ul><li><a href="/">Home</a></ul></nav>{}
<div id="comments"><p>First! This is a rather long comment of a reader who has a lot to say about the article above.</p></div><footer>&copy; us</footer></body></html>"""
BODY = "<h1>The  title</h1><p>One &lt;b&gt; and <b>bold</b>\n text that is long enough to be taken for the main text of the page.<p>Two<br>lines<!-- no --><aside>related things to read which are long as well, so that length alone would keep it</aside><form><p>Your mail</p></form><p>&eacute;nd"
TEXT = "The title\nOne <b> and bold text that is long enough to be taken for the main text of the page.\nTwo lines\nénd"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<article>{}"])
def test_main_text(wrap):
    page = PAGE.replace("{}", wrap.replace("{}", BODY)).replace("p" + "{}", "p{}")
    assert html.main_text(page.replace("<article>{}", "<article>" + BODY)) == TEXT


@pytest.mark.parametrize("page, want", [("", ""), ("<p>", ""), ("just text", "just text"), ("<script>x", ""), ("<!-- open", ""), ("<p>a<p>b", "a\nb"), ("<nav>menu</nav>", ""), ("a &amp;amp; b", "a &amp; b"), ("<article></article><p>outside", "outside")])
def test_small_pages(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_left_out_blocks_end_no_text(wrap):
    advert = "<div class='ad'><p>Buy<p>more<p>now</div>"
    page = wrap.replace("{}", f"<p>{'word ' * 40}</p>{advert}<h2>Sub</h2>{advert}<p>A short closing paragraph.</p>")
    assert html.main_text(page) == f"{('word ' * 40).strip()}\nSub\nA short closing paragraph."


def without_names(page, tags):
    """The page with these elements renamed to div, and without names."""
    return re.sub(r'<div class="[^"]*">', "<div>", re.sub(rf"<(/?)(?:{tags})(?=[\s>])[^>]*>", r"<\1div>", page))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("tags", ["nav|article|footer|header|aside|main", "nav|article|footer|header|aside|main|ul|li|h1|p"])
def test_density_finds_the_article_without_markup(spark, tags):
    """The planted article, read by a plain rule from the marked page, comes out of the page without its marks in at least 95 of 100."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    found = 0
    for page in pages:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert html.main_text(page) == want
        found += html.main_text(without_names(page, tags)) == want
    assert found >= 0.95 * len(pages)


def test_density_cuts_what_stands_around_the_text():
    text = [f"<div>{'words of the text ' * n}</div>" for n in (20, 3, 25, 1, 18)]
    page = "<div><a href=x>Home</a></div><div>Buy it now</div><h2>The head</h2>" + "".join(text) + "<div>© us, all of us</div><div><a href=y>More</a></div>"
    kept = html.main_text(page).split("\n")
    assert kept[0] == "The head" and len(kept) == 6 and html.main_text(page.replace("<h2>", "<div>").replace("</h2>", "</div>")).split("\n")[1:] == kept[1:]
    assert html.level([10, 10, 100]) == 100 and html.level([5] * 7) == 5 and html.level([]) == 0


def test_long_and_nested_pages():
    deep = "<div>" * 20_000 + "<p>" + "deep words here " * 30 + "</p>" + "</div>" * 20_000
    began = time.time()
    assert html.main_text(deep) == ("deep words here " * 30).strip()
    long = "<article>" + "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(60_000)) + "</article>"
    assert html.main_text(long).count("\n") == 59_999 and time.time() - began < 20


def test_pages_give_a_row_each(spark):
    rows = [(1, "u", "<p>a b"), (1, "u", "<p>a b"), (None, None, None), (3, "v", "")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3), (3, "", 0)]


# --- packing ---


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.choice([rnd.randint(1, 100), rnd.randint(1, 60)]) for _ in range(rnd.randint(1, 800)))
    places = packing.plan(counts, 100)
    used, ranks = defaultdict(list), defaultdict(list)
    for size, low, high, base, offset in places:
        ranks[size].append((low, high))
        for k in range(high - low):
            used[base + k].append((offset, size))
    for size, n in counts.items():
        spans = sorted(ranks[size])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and sum(s for _, s in own) <= 100
        assert sum(3 * s > 100 for _, s in own) <= 2
    assert len(used) <= 1.05 * sum(s * n for s, n in counts.items()) / 100 + sum(n for s, n in counts.items() if s > 50) * 0.5 + 2


def test_packing_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    assert own.encode("<|endoftext|> end", add_special_tokens=False).ids[0] == 50256
    got = packing.pack_documents(docs, path, 256).toPandas().sort_values(["doc_id", "piece"])
    parts = dict(list(got.groupby("doc_id")))
    for i, text, *_ in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = parts[i]
        assert mine["piece"].tolist() == list(range(-(-len(ids) // 256))) and mine["length"].tolist()[1:] == [256] * (len(mine) - 1) and mine["length"].sum() == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine["start"], mine["length"], mine["ids_crc32"], strict=True))
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"] == seq["length"].cumsum() - seq["length"]).all() and seq["length"].sum() <= 256


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, ids = Tokenizer.from_file(path), packing.tokenizer_ids(path)
    rnd = random.Random(7)
    texts = ["<|endoftext|>", "a <|endoftext|><|endoftext|> b", " " * 3000 + "x", "x " + " \n" * 400_000 + "y", "\n\n \n" * 700, "'s 's\"'t' don't 12a3 ½x", "日本語 текст", "a\x85b\xa0c", "ab" * 20_000]
    texts += ["".join(rnd.choice("ab '\n\tst3é–…x  ") for _ in range(rnd.randint(1, 90))) for _ in range(400)]
    assert all(ids(t) == own.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("change", ["normalizer", "prefix", "pattern", "unreachable"])
def test_other_tokenizers_are_asked_themselves(tmp_path, change):
    import json

    from tokenizers import Tokenizer

    told = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    if change == "normalizer":
        told["normalizer"] = {"type": "Lowercase"}
    elif change == "prefix":
        told["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "pattern":
        told["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, told["pre_tokenizer"]]}
    else:
        del told["model"]["merges"][500]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    own, ids = Tokenizer.from_file(str(path)), packing.tokenizer_ids(str(path))
    assert packing._ranked_merges(own) is None
    assert all(ids(t) == own.encode(t, add_special_tokens=False).ids for t in ("Hello World 1234", "the THE cat", " x"))


# --- hostile tables ---


def _labels(spark, docs):
    return spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, quality int")


def runs(spark, docs):
    path, multi = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    yield "minhash", minhash.near_duplicates(docs), True
    yield "search", search.search(search.build_index(docs).cache(), docs.withColumnRenamed("doc_id", "item_id").limit(4)), None
    yield "bpe", bpe.decode(bpe.encode(docs, multi, public_tokenizers.PATTERN), multi), True
    yield "quality", quality.classify(docs, _labels(spark, docs)), True
    yield "licenses", licenses.scan_licenses(docs), True
    yield "language", language.identify(docs), True
    yield "substrings", substrings.remove_repeats(docs), True
    yield "packing", packing.pack_documents(docs, path), None


def test_empty_tables(spark, nothing):
    for name, df, _ in runs(spark, nothing):
        assert df.count() == 0, name
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_odd_tables(spark, odd):
    n = odd.count()
    for name, df, each in runs(spark, odd):
        got = df.collect()
        if each:
            assert len(got) == n, name
        elif name == "packing":
            assert sum(r["piece"] == 0 for r in got) == n


def test_rows_with_one_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d"), (1, None), (1, "a b c d"), (2, "a b c d"), (2, "p q r s t"), (None, "a b c d"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 1, 0, True), (0, 2, 0, True), (1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 3, 2, True)]
    cut = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs, 4).collect())
    assert cut == [(0, 1, 0), (0, 4, 4), (1, 0, 0), (1, 4, 4), (1, 4, 4), (2, 4, 4), (2, 5, 0)]
    both = [(1, "All rights reserved"), (1, "x"), (None, "cc by"), (None, None)]
    assert sorted(r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(both, "doc_id long, text string")).collect()) == ["", "", "cc-by", "reserved"]


def test_vectors_without_or_with_one_id(spark):
    one, two = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(None, one, 0), (None, one, 0), (7, one, 0), (7, two, 0), (3, one, 0), (9, two, 0), (9, two, 0), (4, None, 0)]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("unit", "h1", "dims", "copies", "component", "v")})
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in vectors.link_vectors(got).collect())
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (3, 1, 3, True), (4, 0, 4, True), (7, 1, 3, False), (7, 2, 7, True), (9, 2, 7, False), (9, 2, 7, False)]


def test_long_texts_are_read_in_stretches(spark, docs, rows, monkeypatch):
    """The same results where nearly every text is taken a few words at a time."""
    from lodestone.llm import common

    asked = spark.createDataFrame([(0, " ".join((rows[3][1] or "").split()[:30])), (1, "tala KONE")], "item_id long, text string")
    few = [r for r in rows if r[1]][:40] + [(900, rows[0][1] + " " + rows[5][1], "xx", None, 1)]
    some = spark.createDataFrame(few, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    long = lambda df: sorted(map(tuple, df.collect()), key=repr)

    def every():
        import pyarrow as pa

        own = [pa.array([r[1]]) for r in few]
        yield [tuple(map(np.ndarray.tolist, minhash.shingle_sets(t, 3))) for t in own]
        yield [tuple(map(np.ndarray.tolist, search._postings(t))) for t in own]
        yield [substrings_scan(r[1]) for r in few]
        yield [np.concatenate(quality.features(t, pa.array(["x"]), pa.array([None], pa.string())), 1).tolist() for t in own]

    def substrings_scan(text):
        import pyarrow as pa

        own = pa.array([text.encode()], pa.large_binary())
        if common.long_text(own) is None:
            win = substrings.Windows(common.Words(own, second=True), 7)
            return [len(win.words.starts), [int(x[0]) for x in map(common.signed, win.texts())], hashlib.sha256(b" ".join(text.encode().split())).hexdigest(), *(x.tolist() for x in substrings._picks(win))]
        n, both, sha, *picks = substrings._long_scan(text.encode(), 7)
        return [n, both, sha, *(x.tolist() for x in picks)]

    whole = list(every())
    cut = [substrings._cut(r[1].encode(), np.array([0, 3]), 2) for r in few]
    monkeypatch.setattr(common, "PASS_BYTES", 60)
    assert sum(common.long_text(__import__("pyarrow").array([r[1]])) is not None for r in few) > 30
    assert list(every()) == whole and [substrings._cut(r[1].encode(), np.array([0, 3]), 2) for r in few] == cut
    assert long(substrings.remove_repeats(some, 7).drop("kept")) == sorted(((i, *w[:3]) for i, w in removed_slowly(few, 7).items()), key=repr)
    assert asked.count() == 2


# --- pipeline ---


def test_pipeline_equals_its_parts(spark, tmp_path, rows):
    good = [r for r in rows if r[1]] + [(5000, " ".join(rows[0][1].split()) + " " + "kola rine " * 200_000, "xx", "s1", 1)]
    spark.createDataFrame(good, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    named = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert named.columns == docs.columns and docs.count() - named.count() == sum(not any(c.isalpha() for c in r[1]) for r in good)
    judged = corpus_pipeline.quality_stage(spark, named, str(tmp_path))
    left = [tuple(r) for r in judged.collect()]
    _, comps = near_copies(left, 80, 5)
    fresh = corpus_pipeline.near_dedup(spark, judged, str(tmp_path))
    assert sorted(r["doc_id"] for r in fresh.collect()) == sorted(i for i in comps if comps[i] == i)
    one = [tuple(r) for r in fresh.collect()]
    want = removed_slowly(one, 35)
    cut = corpus_pipeline.substrings_stage(spark, fresh, str(tmp_path))
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {i: want[i][3] if want[i][1] else t for i, t, *_ in one}
    packed = corpus_pipeline.packing_stage(spark, cut, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(packed.collect()) == sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect())


def test_pipeline_on_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    _labels(spark, odd).write.parquet(str(tmp_path / "labels.parquet"))
    for table in (odd, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()
            if name != "packing":
                assert docs.columns == table.columns
            if name == "near_dedup":
                texts = [r["text"] for r in docs.collect() if r["text"]]
                assert len(texts) == len(set(texts))


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 13)] + ["pipeline"]
    assert corpus_pipeline.ORACLE_SQL is None
