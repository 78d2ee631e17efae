"""Web pages to typed items: headings with their levels, paragraphs, lists, code, tables as cells with spans, in the order of the page; character references are decoded and nothing is left out but what no reader sees."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ingest import CELL, clean, grid_table, header_rows

ITEMS = f"seq int, label string, text string, level int, marker string, language string, caption string, table_headers array<string>, table_rows array<map<string,string>>, table_cells array<{CELL}>"
_UNSEEN = frozenset(("script", "style", "template", "noscript", "svg", "math", "iframe", "object"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input button select option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LABELS = {"title": "title", "li": "list_item", "dt": "list_item", "dd": "list_item", "pre": "code", "footer": "page_footer", "header": "page_header", "figcaption": "caption"}
_HEADING = re.compile(r"h([1-6])")
_BLANKS = re.compile(r"\s+")
_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;?)")
#: The largest spans that browsers take.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534


def _span(attributes: dict, name: str, most: int) -> int:
    given = (attributes.get(name) or "").strip()
    return min(most, max(1, int(given))) if given.isdecimal() else 1


def placed(rows: list[list[dict]]) -> tuple[list[dict], int]:
    """The cells of table rows (text, rows, columns, header flags) at their places, past those that spans from above hold, and the number of columns."""
    cells: list[dict] = []
    held: dict[int, int] = {}  # column -> first row that is free again
    width = 0
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while held.get(c, 0) > r:
                c += 1
            end, bottom = c + cell["columns"], min(len(rows), r + cell["rows"])
            cells.append({"text": cell["text"], "row_start": r, "row_end": bottom, "column_start": c, "column_end": end, "is_column_header": cell["head"], "is_row_header": cell["side"], "is_row_section": False})
            held |= dict.fromkeys(range(c, end), bottom)
            width, c = max(width, end), end
    return cells, width


def grid(cells: list[dict], height: int, width: int) -> list[list[dict]]:
    """Rows and columns of cells, each at all places that it spans; a place without one has an empty cell."""
    out = [[{"text": "", "row_start": r, "column_start": c, "column_end": c + 1} for c in range(width)] for r in range(height)]
    for cell in cells:
        for r in range(cell["row_start"], cell["row_end"]):
            out[r][cell["column_start"] : cell["column_end"]] = [cell] * (cell["column_end"] - cell["column_start"])
    return out


class _Cell:
    """A cell as placed() takes it; less than a dict, since a page may have a million."""

    __slots__ = ("text", "rows", "columns", "th", "head", "side")

    def __init__(self, **values) -> None:
        for k, v in values.items():
            setattr(self, k, v)

    def __getitem__(self, key: str):
        return getattr(self, key)


def table_parts(rows: list[list], most: int) -> Iterator[dict]:
    """A table row by row, as grid() and grid_table() would have it whole: (text, table_headers, table_rows, row_from) of `most` rows with a text at a time, row_from of which are in earlier parts; one part at least."""

    def laid() -> Iterator[tuple[list, list]]:
        """(cells that begin in the row, as dicts; all that lie in it), in the order in which they hold their places."""
        held: dict[int, int] = {}
        open_: list[dict] = []
        for r, row in enumerate(rows):
            open_ = [x for x in open_ if x["row_end"] > r]
            c, own = 0, []
            only = all(cell["th"] for cell in row)
            for cell in row:
                while held.get(c, 0) > r:
                    c += 1
                end, bottom = c + cell["columns"], min(len(rows), r + cell["rows"])
                own.append({"text": cell["text"], "row_start": r, "row_end": bottom, "column_start": c, "column_end": end, "is_column_header": cell["head"] and only})
                held |= dict.fromkeys(range(c, end), bottom)
                c = end
            open_ += own
            yield own, open_

    width = max((x["column_end"] for own, _ in laid() for x in own), default=0)
    head: list[list[dict]] = []
    headers: list[str] | None = None
    lines, found, before = [], [], 0
    for r, (own, every) in enumerate(laid()):
        line = [{"text": "", "row_start": r, "column_start": c, "column_end": c + 1} for c in range(width)]
        for x in every:
            line[x["column_start"] : x["column_end"]] = [x] * (x["column_end"] - x["column_start"])
        if headers is None and header_rows([line], width, r):
            head.append(line)
        else:
            headers = grid_table(head, width)[0] if headers is None else headers
            values = dict(zip(headers, (clean(x["text"]) for x in line), strict=False))
            if any(values.values()):
                if len(found) == most:
                    yield {"text": "\n".join(lines), "table_headers": headers, "table_rows": found, "row_from": before}
                    lines, found, before = [], [], before + most
                found.append(values)
        lines.append("| " + " | ".join(x["text"] for x in own) + " |")
    yield {"text": "\n".join(lines), "table_headers": grid_table(head, width)[0] if headers is None else headers, "table_rows": found, "row_from": before}


class _Page(HTMLParser):
    """Collects the items of one page. A table in a cell is text of that cell. most: tables with more rows are items with `parts`, which gives theirs."""

    def __init__(self, most: int | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.most = most
        self.items: list[dict] = []
        self.open: list[str] = []  # elements that are neither void nor inline
        self.counters: list[int | None] = []  # of lists: the last number, None for a list without
        self.text: list[str] = []
        self.unseen = 0
        self.language = ""
        self.tables = 0
        self.rows: list[list[_Cell]] = []
        self.caption = ""
        self.cell: _Cell | None = None

    def item(self, label: str, text: str, **more) -> None:
        if text or more.get("table_cells"):
            self.items.append({"seq": len(self.items), "label": label, "text": text, "level": None, "marker": None, "language": None, "caption": None, "table_headers": None, "table_rows": None, "table_cells": None, **more})

    def flush(self) -> None:
        raw = "".join(self.text)
        self.text.clear()
        if "pre" in self.open and not self.tables:
            return self.item("code", raw.strip("\r\n").rstrip(), language=self.language)
        text = _BLANKS.sub(" ", raw).strip()
        if self.tables:
            if text and "caption" in self.open:
                self.caption = f"{self.caption} {text}".strip()
            elif text and self.cell is not None:
                self.cell.text = f"{self.cell.text} {text}".strip()
            elif text:
                self.item("text", text)
            return None
        inner = next((t for t in reversed(self.open) if t in _LABELS or _HEADING.fullmatch(t)), "")
        if m := _HEADING.fullmatch(inner):
            return self.item("section_header", text, level=int(m[1]))
        label = _LABELS.get(inner, "text")
        number = self.counters[-1] if self.counters else None
        return self.item(label, text, marker=(f"{number}." if number is not None else "-") if label == "list_item" else None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _UNSEEN:
            self.unseen += 1
            return
        if self.unseen:
            return
        if tag == "br":
            self.text.append("\n" if "pre" in self.open else " ")
        if tag in _INLINE or tag in _VOID or tag == "code":
            if tag == "code" and "pre" in self.open:
                self.language = self.language or _language(dict(attrs))
            return
        self.flush()
        self.implied(tag)
        given = dict(attrs)
        if tag in ("ul", "ol"):
            start = (given.get("start") or "1").strip()
            self.counters.append(None if tag == "ul" else int(start) - 1 if start.lstrip("-").isdecimal() else 0)
        elif tag == "li" and self.counters and self.counters[-1] is not None:
            self.counters[-1] += 1
        elif tag == "pre":
            self.language = _language(given)
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.rows, self.caption, self.cell = [], "", None
        elif self.tables == 1 and tag == "tr":
            self.rows.append([])
        elif self.tables == 1 and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            top = tag == "th" and ("thead" in self.open or all(c["th"] for c in self.rows[-1]))
            self.cell = _Cell(text="", rows=_span(given, "rowspan", MOST_ROWS), columns=_span(given, "colspan", MOST_COLUMNS), th=tag == "th", head=top, side=tag == "th" and not top)
            self.rows[-1].append(self.cell)
        self.open.append(tag)

    def implied(self, tag: str) -> None:
        """Close what the start of this element closes."""
        closes = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}.get(tag, ("p",) if self.open and self.open[-1] == "p" else ())
        while self.open and self.open[-1] in closes:
            self.closed(self.open.pop())

    def handle_endtag(self, tag: str) -> None:
        if tag in _UNSEEN:
            self.unseen = max(0, self.unseen - 1)
            return
        if self.unseen or tag in _INLINE or tag in _VOID or tag == "code":
            return
        self.flush()
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.closed(last)
            self.closed(tag)

    def closed(self, tag: str) -> None:
        if tag in ("ul", "ol") and self.counters:
            self.counters.pop()
        elif tag in ("td", "th") and self.tables == 1:
            self.cell = None
        elif tag == "table":
            self.tables -= 1
            if not self.tables and self.most is not None and len(self.rows) > self.most:
                self.item("table", "|", caption=self.caption, parts=table_parts(self.rows, self.most))
            elif not self.tables:
                cells, width = placed(self.rows)
                only = [all(c["th"] for c in row) for row in self.rows]
                for row, column in ((c["row_start"], c) for c in cells):  # a row with other cells than headers has headers of the row
                    if column["is_column_header"] and not only[row]:
                        column |= {"is_column_header": False, "is_row_header": True}
                headers, rows = grid_table(grid(cells, len(self.rows), width), width)
                texts: list[list[str]] = [[] for _ in self.rows]  # of the cells that begin in each row
                for c in cells:
                    texts[c["row_start"]].append(c["text"])
                shown = "\n".join("| " + " | ".join(t) + " |" for t in texts)
                self.item("table", shown, caption=self.caption, table_headers=headers, table_rows=rows, table_cells=cells)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)


def _language(attributes: dict) -> str:
    """The language that a class names, as in language-sql."""
    m = re.search(r"(?:^|\s)lang(?:uage)?-(\S+)", attributes.get("class") or "")
    return m[1] if m else ""


def _ended(page: str, bare: Collection[str]) -> str:
    """page, where a reference that lacks its semicolon is plain text, unless its name is in bare."""

    def shown(m: re.Match) -> str:
        name = m[1]
        if m[2] and (name[0] == "#" or f"{name};" in html5):
            return m[0]
        known = next((name[:n] for n in range(len(name), 1, -1) if name[:n] in html5), None)
        return m[0] if known in bare else f"&amp;{m[0][1:]}"

    return _REFERENCE.sub(shown, page)


def items_of(page: str, bare: Collection[str] | None = None, most: int | None = None) -> list[dict]:
    """The items of one page; elements that are never closed end with it. most: as _Page has it. bare: names of references that are decoded without their semicolon too; None: all that browsers decode so."""
    parser = _Page(most)
    parser.feed(page if bare is None else _ended(page, bare))
    parser.close()
    parser.flush()
    while parser.open:
        parser.closed(parser.open.pop())
    return parser.items


#: Items, at least, that a task hands on at once.
PIECE = 1000


def _pieces(pdf: pd.DataFrame, bare: Collection[str] | None = None, most: int | None = None) -> Iterator[pd.DataFrame]:
    """The items of pages (doc_id, html), handed on once they and their rows of tables are PIECE, so that a task holds those of few pages, however many come at once; with most, tables with more rows come in parts of so many."""
    found: list[dict] = []
    n = 0
    names = ["doc_id", *_NAMES, *(["row_from"] if most is not None else [])]
    for i, page in zip(pdf["doc_id"], pdf["html"], strict=True):
        for x in items_of(page or "", bare, most):
            parts = x.pop("parts", None)
            for part in [{}] if parts is None else parts:
                found.append({"doc_id": i, "row_from": 0, **x, **part})
                n += 1 + len(found[-1]["table_rows"] or ()) * (parts is not None)
                if n >= PIECE and parts is not None:
                    yield pd.DataFrame(found, columns=names)
                    found, n = [], 0
        if n >= PIECE:
            yield pd.DataFrame(found, columns=names)
            found, n = [], 0
    yield pd.DataFrame(found, columns=names)


def items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bare: Collection[str] | None = None, most: int | None = None) -> DataFrame:
    """Items of each row of pages, as ingest.extract_blocks() takes them: doc_id, seq from 0, label, text, level, marker, language, caption, tables; all on page 1 of 1. A null or empty page has none.

    Titles, headings of six levels, list items with marker, code with its language, tables, captions, page headers and footers have labels of their own; everything else is text.
    bare: as items_of() has it. most: a table with more rows is several items with the same seq, each with so many of its rows, without cells, and row_from, how many come before; so no later step holds a whole table.
    """
    kind = dict(pages.dtypes)[id_col]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield from _pieces(pdf, bare, most)

    rows = pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(read, f"doc_id {kind}, {ITEMS}{', row_from int' if most is not None else ''}")
    return rows.withColumns({"pages": F.array(F.lit(1)), "page_count": F.lit(1), "self_ref": F.concat(F.lit("#"), F.col("seq").cast("string")), "captions": F.array().cast("array<string>")})


_NAMES = ["seq", "label", "text", "level", "marker", "language", "caption", "table_headers", "table_rows", "table_cells"]
