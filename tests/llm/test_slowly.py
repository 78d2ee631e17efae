"""The two fitted operators against slow versions: naive Bayes over dictionaries, co-training over sorted lists."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language, quality


def gram_bucket(gram: str, buckets: int) -> int:
    """The bucket of an n-gram, character by character in 64 bits."""
    h = 0
    for k, c in enumerate(gram):
        h = ((h * 0x100000001B3) & (2**64 - 1)) ^ (ord(c) + (k << 32))
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & (2**64 - 1)
    return (h ^ h >> 31) % buckets


def grams_slowly(text: str, buckets: int) -> Counter:
    padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return Counter(gram_bucket(g, buckets) for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip(" "))


def bayes_slowly(rows, buckets=1 << 16):
    """doc_id -> label and its probability, of rows (doc_id, text, lang)."""
    counts, priors = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts[lang] += grams_slowly(text, buckets)
            priors[lang] += 1
    totals = {lang: sum(counts[lang].values()) + 0.1 * buckets for lang in priors}
    out = {}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out[i] = (language.UNDETERMINED, 0.0)
            continue
        seen = grams_slowly(text, buckets)
        logs = {lang: math.log(priors[lang] / sum(priors.values())) + sum(n * math.log((counts[lang][b] + 0.1) / totals[lang]) for b, n in seen.items()) for lang in sorted(priors)}
        best = max(logs, key=logs.get)  # the first of equal ones
        out[i] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    return out


def test_language_equals_naive_bayes_over_dictionaries(spark):
    rnd = random.Random(5)
    sounds = {"aa": "kalomeri ", "bb": "strunghek ", "cc": "çéàçêiola "}
    rows = [(i, "".join(rnd.choice(sounds[lang]) for _ in range(rnd.randint(1, 60))), lang if i % 9 else None) for i in range(120) for lang in [rnd.choice(list(sounds))]]
    rows += [(500, None, "aa"), (501, "1 2!", "bb"), (502, "", None), (503, "日本 Ünï x1y", None), (504, "l" * 3000, None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    want = bayes_slowly(rows)
    assert {i: r["lang_pred"] for i, r in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(got[i]["score"] == pytest.approx(p, abs=2e-3) for i, (_, p) in want.items())  # log-probabilities are of single precision


def test_language_ties_go_to_the_label_that_sorts_first(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "same text", "bb" if k % 2 else "aa") for k, i in enumerate(ids[:40])] + [(900, "same", None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {r["lang_pred"] for r in got.values()} == {"aa"} and got[900]["score"] == pytest.approx(0.5)


def quality_rows(n=500):
    rnd = random.Random(9)
    stems = [a + b for a in ("ta", "ko", "ri", "mu", "se") for b in ("la", "ne", "po", "zu", "st")]
    rows = []
    for i in range(n):
        bad = rnd.random() < 0.4
        words = [rnd.choice(stems[:3] if bad else stems) for _ in range(rnd.randint(5, 90))]
        rows.append((i, " ".join(words).upper() if bad and i % 2 else " ".join(words), "xx", f"s{int(bad) if rnd.random() < 0.8 else 2}", int(not bad)))
    return rows + [(n + j, rows[j][1], "xx", rows[j][3], rows[j][4]) for j in range(0, 200, 4)]  # copies, so that many rows are equally sure


def test_quality_equals_cotraining_over_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_ROUND", 15)
    monkeypatch.setattr(quality.surest, "__defaults__", (0.7, 15))
    rows = quality_rows()
    labelled = {r[0]: r[4] for r in rows if r[0] % 4 == 0}
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(list(labelled.items()), "doc_id long, quality int")

    x = {r[0]: np.concatenate(quality.features(*(pa.array([v], pa.string()) for v in r[1:4])), 1)[0] for r in rows}
    half = spark.createDataFrame([(i, v.astype(np.float16).tobytes()) for i, v in x.items()], "doc_id long, x binary")
    number = {r["doc_id"]: r["row"] for r in half.select("doc_id", F.xxhash64("doc_id", "x").alias("row")).collect()}

    def slowly(views, taken):
        out = []
        for k in (0, 1):
            for label in (1, 0):
                sure = []
                for i, v in x.items():
                    part = v[: quality.TEXT_SIZE] if k == 0 else v[quality.TEXT_SIZE :]
                    p = float(quality._sigmoid(views[k].logit(part[None]))[0])
                    how = p if label else 1 - p
                    if i not in labelled and number[i] not in taken[1 - k] and how >= 0.7:
                        sure.append((-how, number[i], v))
                out += [(k, label, row, v) for _, row, v in sorted(sure, key=lambda s: s[:2])[:15]]
        return out

    ids = sorted(labelled)
    t, m = np.stack([x[i][: quality.TEXT_SIZE] for i in ids]), np.stack([x[i][quality.TEXT_SIZE :] for i in ids])
    rounds = []
    model = quality.cotrain(t, m, np.array([labelled[i] for i in ids], float), lambda v, taken: rounds.append(1) or slowly(v, taken))
    assert len(rounds) == quality.ROUNDS
    want = {i: quality._judged(model, v[None, : quality.TEXT_SIZE], v[None, quality.TEXT_SIZE :], np.array([True]))[:, 0] for i, v in x.items()}
    for layout in (docs.repartition(1), docs.repartition(7), docs.orderBy(F.col("doc_id").desc())):
        got = {r["doc_id"]: r for r in quality.classify(layout, known).collect()}
        assert set(got) == set(want)
        for i, w in want.items():
            assert (got[i]["p_text"], got[i]["p_meta"], got[i]["quality_score"]) == pytest.approx(tuple(w), abs=1e-6)


def test_labelled_rows_are_drawn_by_their_ids(spark):
    """With fewer labelled rows than there are, any layout draws the same ones, and all rows are judged."""
    rows = quality_rows(300)
    docs = spark.createDataFrame([r[:4] for r in rows] + [(0, "another text of the first id", "xx", "s0")], "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    one, two = (sorted((r[0], *(round(v, 9) for v in r[1:4]), r[4]) for r in quality.classify(d, known, max_labelled=60).collect()) for d in (docs.repartition(2), docs.repartition(6)))  # sums of a batch end in other last bits
    assert one == two and len(one) == len(rows) + 1
