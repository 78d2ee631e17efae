from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, empty, null, blank and very long texts, and odd characters."""
    rnd = random.Random(seed)
    stems = [a + b + c for a in ("ta", "ko", "ri", "mu", "sé") for b in ("la", "ne", "po", "zu") for c in ("", "n", "st", "ß")]
    words = lambda k: [rnd.choice(stems) for _ in range(k)]
    passage = words(60)
    texts: list[str | None] = []
    for i in range(n):
        own = words(rnd.randint(1, 160))
        if i % 7 == 3:
            at = rnd.randint(0, len(own))
            own[at:at] = passage
        texts.append(" ".join(w + ("\n" if rnd.random() < 0.1 else "") for w in own))
    for i in range(12):  # near copies
        own = texts[i].split(" ")
        own[rnd.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += texts[:6] + [texts[0].upper()] * 2  # copies, one of which differs by case alone
    texts += [None, "", "  \n\t ", "one", "one two", "a b c\x1fd \x85 x", "日本語 текст 'll it's 12³ ", " ".join(words(6000)), "x" * 3000, "<|endoftext|> end", "123 456 !!"]
    return [(i, t, ("xx", "yy", None)[i % 3], f"s{i % 4}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The same with a null id, repeated rows, and columns that operators might use themselves."""
    more = [(None, "null id text here", "xx", None, None), (None, "null id again", None, None, 1), *rows[:3], (0, None, None, None, None)]
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("n", "key", "id", "label", "score", "kept", "bands", "h1", "salt", "length", "words", "lang_pred", "component_id", "batch")}
    return spark.createDataFrame(rows + more, DOCS).withColumns(extra)
