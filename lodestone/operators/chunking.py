"""Token-budgeted chunks: sentences of long blocks are grouped, units packed greedily with overlap, table rows become chunks of their own.

The packing of a document depends on all that came before, so it is an ordered fold in Python, which holds the chunk it is at, not the document; where that is one row already nothing is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from itertools import count as counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.operators.ingest import clean, folded

CHUNKS = (
    "chunk_id string, doc_id string, chunk_index int, section string, page_start int, page_end int, text string, n_tokens int, chunk_type string, "
    "table_caption string, table_headers array<string>, table_rows array<map<string,string>>, table_row_start int, table_row_end int"
)
Count = Callable[[str], int]


def words(text: str) -> int:
    """The stand-in for a model's tokenizer."""
    return len(text.split())


@dataclass
class Unit:
    text: str
    tokens: int
    section: str = ""
    first_page: int = 0
    last_page: int = 0


def text_units(text: str, most: int, count: Count = words) -> list[tuple[str, int]]:
    """A block as units (text, tokens) within the budget: itself, or its sentences grouped as they come; a longer sentence stays whole."""
    whole = count(text)
    if whole <= most:
        return [(text, whole)]
    out: list[tuple[str, int]] = []
    held: list[str] = []
    total = 0
    for sentence in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", text))):
        n = count(sentence)
        if held and total + n > most:
            out.append((" ".join(held), total))
            held, total = [], 0
        held.append(sentence)
        total += n
    return [*out, (" ".join(held), total)] if held else out


def pack(units: list[Unit], size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (first, last) of the chunks of units. A change of section starts afresh; an overflow repeats as many last units as the overlap holds."""
    spans: list[tuple[int, int]] = []
    first, total = 0, 0
    for i, unit in enumerate(units):
        if i > first:
            if unit.section != units[i - 1].section:
                spans.append((first, i - 1))
                first, total = i, 0
            elif total + unit.tokens > size:
                spans.append((first, i - 1))
                first, total = i, 0
                while first > spans[-1][0] and total + units[first - 1].tokens <= overlap:
                    first -= 1
                    total += units[first].tokens
        total += unit.tokens
    return [*spans, (first, len(units) - 1)] if units else spans


def packed(units: Iterable[Unit], size: int, overlap: int) -> Iterator[list[Unit]]:
    """The units of each of the chunks that pack() gives; only those of one are held."""
    own: list[Unit] = []
    total = 0
    for unit in units:
        if own and unit.section != own[-1].section:
            yield own
            own, total = [], 0
        elif own and total + unit.tokens > size:
            yield own
            first, total = len(own), 0
            while first > 0 and total + own[first - 1].tokens <= overlap:
                first -= 1
                total += own[first].tokens
            own = own[first:]
        own.append(unit)
        total += unit.tokens
    if own:
        yield own


def _lines(*parts: str) -> str:
    return "\n".join(parts)


def _context(block: dict, number: int | None = None) -> list[str]:
    named = [f"{name}: {block[key]}" for name, key in (("Section", "section"), ("Table", "caption")) if block[key]]
    return named if number is None else [*named, f"Row: {number}"]


def _value_pieces(name: str, value: str, fits: Callable[[str], bool]) -> list[str]:
    """A field as lines that fit, cut between words; a word that never fits stands alone."""
    out: list[str] = []
    for word in value.split():
        longer = f"{out[-1]} {word}" if out else ""
        if longer and fits(longer):
            out[-1] = longer
        else:
            out.append(f"{name}: {word}")
    return out


def row_texts(block: dict, row: dict[str, str], number: int, most: int, count: Count = words) -> list[str]:
    """A table row as texts within the budget. Too long a row is cut between fields, each part with the row's context and a short first field;
    too long a field between words."""
    fields = [(h, row[h]) for h in block["table_headers"] if row.get(h)]
    head, shown = _context(block, number), [f"{h}: {v}" for h, v in fields]
    whole = _lines(*head, *shown)
    if count(whole) <= most:
        return [whole]
    short = next((i for i, s in enumerate(shown) if count(s) <= min(64, most // 4)), None)
    if short is not None and len(fields) > 1:
        head, fields = [*head, shown[short]], fields[:short] + fields[short + 1 :]

    def fits(*more: str) -> bool:
        return count(_lines(*head, *more)) <= most

    parts: list[list[str]] = []  # lines of each text
    open_ = False  # whether the last text may take more fields
    for h, v in fields:
        line = f"{h}: {v}"
        if open_ and fits(*parts[-1], line):
            parts[-1].append(line)
        elif fits(line):
            parts.append([line])
            open_ = True
        else:
            parts += [[piece] for piece in _value_pieces(h, v, fits)]
            open_ = False
    return [_lines(*head, *p) for p in parts] or [whole]


def table_texts(block: dict, most: int, count: Count = words) -> list[tuple[str, int, dict]]:
    """(text, row number, row) of each chunk of a table; without rows its headers or its raw text, as row 0."""
    out = [(text, i, row) for i, row in enumerate(block["table_rows"], 1 + (block.get("row_from") or 0)) for text in row_texts(block, row, i, most, count)]
    if out:
        return out
    head = _context(block)
    if block["table_headers"]:
        head.append("Columns: " + ", ".join(block["table_headers"]))
    elif block["text"]:
        head.append("Table content: " + block["text"])
    return [(_lines(*head), 0, {})] if head else []


def chunks_of(doc_id: str, blocks: Iterable[dict], settings: Settings = DEFAULTS, count: Count = words) -> Iterator[dict]:
    """The chunks of a document's blocks in order, as the blocks come."""
    places = counter()

    def chunk(text: str, kind: str, section: str, first: int, last: int, block: dict | None = None, number: int = 0, row: dict | None = None) -> dict:
        at = next(places)
        return {
            "chunk_id": f"{doc_id}-{at:05d}", "doc_id": doc_id, "chunk_index": at, "section": section, "page_start": first, "page_end": last, "text": text, "n_tokens": count(text), "chunk_type": kind,
            "table_caption": block["caption"] if block else "", "table_headers": list(block["table_headers"]) if block else [], "table_rows": [dict(row)] if row else [], "table_row_start": number, "table_row_end": number,
        }

    for is_table, run in groupby(blocks, key=lambda block: block["block_type"] == "table"):
        if is_table:
            for block in run:
                for text, number, row in table_texts(block, settings.chunk_size, count):
                    yield chunk(text, "table", block["section"], block["page_start"], block["page_end"], block, number, row)
        else:
            units = (Unit(t, n, block["section"], block["page_start"], block["page_end"]) for block in run for t, n in text_units(block["text"], settings.chunk_size, count))
            for own in packed(units, settings.chunk_size, settings.chunk_overlap):
                yield chunk("\n\n".join(u.text for u in own), "paragraph", own[0].section, min(u.first_page for u in own), max(u.last_page for u in own))


def document_chunks(doc_id: str, blocks: list[dict], settings: Settings = DEFAULTS, count: Count = words) -> list[dict]:
    return list(chunks_of(doc_id, blocks, settings, count))


def chunk_blocks(blocks: DataFrame, settings: Settings = DEFAULTS, count: Count = words) -> DataFrame:
    """Chunks of blocks, document by document; a fold over each document's blocks as they come."""

    def fold(own: Iterator[dict]) -> Iterator[dict]:
        first = next(own)
        return chunks_of(str(first["doc_id"]), chain([first], own), settings, count)

    return folded(blocks, fold, CHUNKS)


def split_units(blocks: DataFrame, most: int, count: Count = words, by: tuple[str, ...] = ("doc_id", "seq")) -> DataFrame:
    """(doc_id, seq, unit_no, text, n_tokens): the units of each block, where it lies."""

    def split(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(*key, i, text, n) for *key, whole in pdf[[*by, "text"]].itertuples(index=False) for i, (text, n) in enumerate(text_units(whole or "", most, count))]
            yield pd.DataFrame(rows, columns=[*by, "unit_no", "text", "n_tokens"])

    kinds = ", ".join(f"{c} {dict(blocks.dtypes)[c]}" for c in by)
    return blocks.select(*by, "text").mapInPandas(split, f"{kinds}, unit_no int, text string, n_tokens long")


def chunk_documents(docs: DataFrame, settings: Settings = DEFAULTS, count: Count = words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What chunk_blocks() gives for plain documents of one row each, whose non-empty lines are blocks on page 1 and in no section; no shuffle."""

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        plain = {"block_type": "text", "section": "", "page_start": 1, "page_end": 1}
        for pdf in it:
            rows = [c for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) for c in document_chunks(str(doc), [{**plain, "text": line} for line in map(clean, (text or "").split("\n")) if line], settings, count)]
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(fold, CHUNKS)


def pack_documents(docs: DataFrame, size: int, overlap: int, count: Count = words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, first_unit, last_unit, n_tokens, text) of documents of one row each, whose non-empty lines are units; no shuffle."""

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                units = [Unit(line, count(line)) for line in map(clean, (text or "").split("\n")) if line]
                for i, (a, b) in enumerate(pack(units, size, overlap)):
                    own = units[a : b + 1]
                    rows.append((doc, i, a, b, sum(u.tokens for u in own), "\n\n".join(u.text for u in own)))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "first_unit", "last_unit", "n_tokens", "text"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(fold, "doc_id long, chunk_index int, first_unit int, last_unit int, n_tokens long, text string")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, and their smallest, mean (whole) and largest number of tokens."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.min("n_tokens").cast("long").alias("min_tokens"), F.expr("sum(n_tokens) div count(*)").alias("mean_tokens"), F.max("n_tokens").cast("long").alias("max_tokens"))
