"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for lexical matching.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "their",
    "this", "to", "what", "when", "which", "with",
)
TOKEN = r"[a-z0-9][a-z0-9_.-]*"
EDGES = r"^\s+|\s+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(c), EDGES, "")


def clean(c: Column | str) -> Column:
    """Soft hyphens go, two ligatures are spelt out, runs of blanks and of three or more line feeds shrink, ends are stripped."""
    x = F.regexp_replace(_col(c), "­", "")
    x = F.regexp_replace(F.regexp_replace(x, "ﬁ", "fi"), "ﬂ", "fl")
    return strip(F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def collapse(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r"\s+", " "))


def normalize_heading(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


def normalise(c: Column | str) -> Column:
    """Lower case, white space collapsed. (Lower-casing is not full case folding: a sharp s stays.)"""
    return collapse(F.lower(_col(c)))


def token_list(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0))


def token_set(c: Column | str) -> Column:
    """Distinct tokens without stop words."""
    return F.array_except(token_list(c), F.array(*map(F.lit, STOPWORDS)))


def sentences(c: Column | str) -> Column:
    """Sentences: the text is cut at white space after a full stop, exclamation or question mark; empty ones go."""
    return F.filter(F.transform(F.split(_col(c), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def count_tokens(c: Column | str) -> Column:
    """Words between white space: the stand-in for a model's tokenizer."""
    return F.size(F.filter(F.split(_col(c), r"\s+"), lambda w: w != ""))


def markdown(label: Column | str, text: Column | str, level: Column | str, marker: Column | str, language: Column | str) -> Column:
    """A typed item as Markdown."""
    label, text = _col(label), clean(text)
    hashes = F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(_col(level), F.lit(1)))))
    bullet = strip(F.when(F.coalesce(_col(marker), F.lit("")) == "", "-").otherwise(_col(marker)))
    done = (
        F.when(label == "section_header", F.concat(hashes, F.lit(" "), text))
        .when(label == "title", F.concat(F.lit("# "), text))
        .when(label == "list_item", strip(F.concat(bullet, F.lit(" "), text)))
        .when(label == "code", F.concat(F.lit("```"), F.coalesce(_col(language), F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when(label == "formula", F.concat(F.lit("$$"), text, F.lit("$$")))
        .otherwise(text)
    )
    return F.when(text == "", "").otherwise(done)


def page_label(start: Column | str, end: Column | str) -> Column:
    start, end = _col(start).cast("string"), _col(end).cast("string")
    return F.when(start == end, F.concat(F.lit("p."), start)).otherwise(F.concat(F.lit("pp."), start, F.lit("-"), end))


def citation(source: Column | str, section: Column | str, start: Column | str, end: Column | str) -> Column:
    """`source, section, p.N` or `pp.N-M`; an empty section is left out."""
    section = _col(section)
    return F.concat(_col(source), F.when(F.coalesce(section, F.lit("")) == "", "").otherwise(F.concat(F.lit(", "), section)), F.lit(", "), page_label(start, end))


def quote(c: Column | str, most: int = 220) -> Column:
    """The first characters of the collapsed text, with dots if that fills the quote."""
    head = F.substring(collapse(c), 1, most)
    return F.concat(head, F.when(F.length(head) == most, "...").otherwise(""))


def _numbers(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(r"\[(\d+)\]"), F.lit(1))


def markers(c: Column | str) -> Column:
    """Numbers in square brackets, in order; null where one is too large for any passage."""
    return F.transform(_numbers(c), lambda m: m.try_cast("int"))


def _valid(m: Column, n: Column) -> Column:
    return F.coalesce(m.try_cast("int").between(1, n), F.lit(False))


def dropped_markers(c: Column | str, n: Column | str) -> Column:
    """Distinct markers out of 1..n, sorted, of up to 38 digits."""
    n = _col(n)
    bad = F.transform(F.filter(_numbers(c), lambda m: ~_valid(m, n)), lambda m: m.try_cast("decimal(38,0)"))
    return F.array_sort(F.array_distinct(F.filter(bad, lambda m: m.isNotNull())))


def without_markers(c: Column | str, n: Column | str) -> Column:
    """The text without markers out of 1..n; blanks before punctuation and double blanks close up only where something was dropped."""
    c, n = _col(c), _col(n)
    bad = F.array_distinct(F.filter(_numbers(c), lambda m: ~_valid(m, n)))
    bare = F.aggregate(bad, c, lambda s, m: F.replace(s, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(bare, " +([.,;:])", "$1"), " {2,}", " ")
    return F.when(F.size(bad) > 0, tidy).otherwise(c)


def compact(c: Column | str, most: int) -> Column:
    """Long text cut, with how much is missing."""
    c = _col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("...<truncated "), (F.length(c) - most).cast("string"), F.lit(" chars>"))).otherwise(c)


def doc_id(name: Column | str) -> Column:
    return F.substring(F.sha1(_col(name)), 1, 12)


def chunk_id(doc: Column | str, index: Column | str) -> Column:
    return F.format_string("%s-%05d", _col(doc), _col(index).cast("long"))


def index_of_chunk(doc: Column | str, chunk: Column | str, index: Column | str) -> Column:
    """The chunk's index, or where it is null the digits after the document's prefix, or -1."""
    doc, chunk = _col(doc), _col(chunk)
    rest = F.when((doc != "") & chunk.startswith(F.concat(doc, F.lit("-"))), F.substr(chunk, F.length(doc) + 2))
    return F.coalesce(_col(index).cast("int"), F.when(rest.rlike(r"^\d+$"), rest.try_cast("int")), F.lit(-1))


def keyword_recall(answer: Column | str, keywords: Column | str) -> Column:
    """Share of the keywords that the answer has, case aside; null without keywords."""
    answer, keywords = F.lower(_col(answer)), _col(keywords)
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: F.contains(answer, F.lower(k)))) / F.size(keywords))


def source_hit(cited: Column | str, expected: Column | str) -> Column:
    cited, expected = _col(cited), _col(expected)
    return F.when(F.size(expected) > 0, F.when(F.arrays_overlap(cited, expected), 1.0).otherwise(0.0))


def source_precision(cited: Column | str, expected: Column | str) -> Column:
    cited, expected = _col(cited), _col(expected)
    share = F.size(F.filter(cited, lambda s: F.array_contains(expected, s))) / F.nullif(F.size(cited), F.lit(0))
    return F.when(F.size(expected) > 0, F.coalesce(share, F.lit(0.0)))


def percent(c: Column | str, digits: int = 2) -> Column:
    c = _col(c)
    return F.when(c.isNull(), "—").otherwise(F.format_string(f"%.{digits}f%%", c * 100))


def delta(value: Column | str, reference: Column | str, comparable: Column) -> Column:
    moved = (_col(value) - _col(reference)) * 100
    return F.when(comparable & moved.isNotNull(), F.format_string("%+.2f pp", moved)).otherwise("—")


def change(value: Column | str, reference: Column | str, digits: int = 2) -> Column:
    """How much smaller a value is than the reference, as a percentage; a dash where either is missing or the reference is 0."""
    value, reference = _col(value), _col(reference)
    return percent(F.when(reference != 0, 1 - value / reference), digits)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in doubles."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
