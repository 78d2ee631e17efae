"""Scalar functions against their definitions in Python."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("a­b ﬁx\t\t y", "ab fix y"), ("a\n\n\n\nb ", "a\n\nb"), ("  ", ""), ("a \n b", "a \n b")])
def test_clean(spark, raw, want):
    assert one(spark, T.clean(F.lit(raw))) == want


def test_heading_and_normalise(spark):
    assert one(spark, T.normalize_heading(F.lit("  3.1 Risk—Management! "))) == "3 1 risk management"
    assert one(spark, T.normalise(F.lit(" A\n b\t C "))) == "a b c"


def test_tokens_leave_out_stop_words(spark):
    assert sorted(one(spark, T.token_set(F.lit("The NIST-800.53 is A test of the NIST-800.53 _x")))) == ["nist-800.53", "test", "x"]


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit("One. Two!  Three? 3.5 four.\nFive"))) == ["One.", "Two!", "Three?", "3.5 four.", "Five"]


@pytest.mark.parametrize("label, level, marker, want", [("section_header", 9, None, "###### x"), ("section_header", None, None, "# x"), ("title", 3, None, "# x"), ("list_item", None, None, "- x"), ("list_item", None, "1.", "1. x"), ("code", None, None, "```\nx\n```"), ("formula", None, None, "$$x$$"), ("text", None, None, "x")])
def test_markdown(spark, label, level, marker, want):
    assert one(spark, T.markdown(F.lit(label), F.lit(" x "), F.lit(level).cast("int"), F.lit(marker).cast("string"), F.lit(""))) == want


def test_citation(spark):
    assert one(spark, T.citation(F.lit("a.pdf"), F.lit("S1"), F.lit(3), F.lit(4))) == "a.pdf, S1, pp.3-4"
    assert one(spark, T.citation(F.lit("a.pdf"), F.lit(""), F.lit(3), F.lit(3))) == "a.pdf, p.3"


@pytest.mark.parametrize("n, dots", [(219, False), (220, True), (221, True)])
def test_quote(spark, n, dots):
    assert one(spark, T.quote(F.lit("x" * n))) == "x" * min(n, 220) + "..." * dots


def test_markers(spark):
    text = "Use MFA [1] , and that [9]. See [3]"
    assert one(spark, T.dropped_markers(F.lit(text), F.lit(2))) == [3, 9]
    assert one(spark, T.without_markers(F.lit(text), F.lit(2))) == "Use MFA [1], and that. See "
    assert one(spark, T.without_markers(F.lit("a  b [1] ."), F.lit(2))) == "a  b [1] ."


@pytest.mark.parametrize("digits, told", [("99999999999", 99999999999), ("0", 0), ("007", 7), ("9" * 60, None)])
def test_markers_of_any_digits(spark, digits, told):
    text = F.lit(f"x [1] y [{digits}].")
    assert one(spark, T.dropped_markers(text, F.lit(2))) == ([told] if told is not None else [])
    assert one(spark, T.without_markers(text, F.lit(2))) == "x [1] y."


def test_ids(spark):
    name = "NIST.CSWP.29.pdf"
    assert one(spark, T.doc_id(F.lit(name))) == hashlib.sha1(name.encode()).hexdigest()[:12] == "17684aea55c3"
    assert one(spark, T.chunk_id(F.lit("d"), F.lit(7))) == "d-00007"
    for index, chunk, want in ((4, "d-00009", 4), (None, "d-00009", 9), (None, "e-00009", -1), (None, "d-x", -1), (None, "d-99999999999", -1)):
        assert one(spark, T.index_of_chunk(F.lit("d"), F.lit(chunk), F.lit(index).cast("int"))) == want


def test_answers_scores(spark):
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    assert one(spark, T.keyword_recall(F.lit("Use MFA now"), words("mfa", "vpn"))) == 0.5
    assert one(spark, T.keyword_recall(F.lit("Use MFA now"), words())) is None
    assert one(spark, T.source_hit(words("a", "b"), words("b"))) == 1.0 and one(spark, T.source_precision(words("a", "b"), words("b"))) == 0.5
    assert one(spark, T.source_precision(words(), words("b"))) == 0.0 and one(spark, T.source_hit(words("a"), words())) is None


def test_formats(spark):
    assert one(spark, T.percent(F.lit(0.4784))) == "47.84%" and one(spark, T.percent(F.lit(None).cast("double"))) == "—"
    assert one(spark, T.delta(F.lit(0.5), F.lit(0.45), F.lit(True))) == "+5.00 pp" and one(spark, T.delta(F.lit(0.5), F.lit(0.45), F.lit(False))) == "—"
    assert re.fullmatch(r"x{5}\.\.\.<truncated 3 chars>", one(spark, T.compact(F.lit("x" * 8), 5)))
