"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line weighs what it has outside links; names and elements only move that weight: lines of menus, headers, forms, notices and the like, told by their element, class, id or role,
weigh nothing wherever they stand, unless such a word marks what holds the page's main text, and where article and main elements hold at least half of all weight, their lines weigh as much as the page's level and those
outside nothing. The level is the length of line that half of the page's weight stands in lines of at least. Weights are summed over sliding windows, and text ends where a window sums to nothing. Between such
places it surges at the first line that reaches a share of the level, and dives after the last one; headings and paragraphs that touch these lines belong to them. All lines that aren't marked between the two are kept.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batches, mapped, table

#: Lines of a window; the share of the page's level at which text surges, and the length that is enough on any page.
WINDOW, SHARE, SURGE = 3, 0.25, 80

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_RAW = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "math", "audio", "video"))
_RAW_END = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*(?:>|\Z)", re.I) for t in _RAW}
_OUT = frozenset(("head", "nav", "header", "footer", "aside", "button", "select", "menu", "dialog", "option"))
_FORM = frozenset(("form", "fieldset", "label"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br label".split())
_CORE = frozenset(("article", "main"))
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_PART = re.compile(r"[a-z0-9]+", re.I)
#: Parts of names that mark what is no text of its own: notices, adverts and readers' comments, and what a layout puts around or beside the text.
_NEVER = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion promotions cookie cookies consent notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup login comment comments replies respond disqus".split())
_LAYOUT = frozenset("banner banners nav navbar navigation menu menus sidebar sidebars breadcrumb breadcrumbs header headers masthead footer footers search share sharing social related recommend recommended recommendations widget widgets toolbar pagination pager complementary contentinfo".split())
#: Parts that say that a name tells of another element, as in has-sidebar.
_OF_OTHERS = frozenset("has have no not with without non is".split())
_CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
_BLANKS = re.compile(r"\s+")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_PARAGRAPHS = frozenset(("p", "pre", "blockquote", "li", "dd", "td", "figcaption"))
#: What a line of rights begins with; where it is no paragraph, it weighs nothing outside article and main.
_RIGHTS = re.compile(r"\W{0,3}(?:©|\(c\)|copyright\b)", re.I)


def _mark(tag: str, attributes: str) -> str:
    """What an element's tag and attributes say: "out", "never", "layout" or nothing."""
    if tag in _OUT:
        return "out"
    told = "layout" if tag in _FORM else ""
    if tag in ("html", "body") or not attributes.strip():
        return told
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and m.start() and attributes[m.start() - 1].isspace() or name == "aria-hidden" and value.lower() == "true":
            told = "layout"
        elif name in ("class", "id", "role"):
            for word in value.split():
                parts = {p.lower() for p in _PART.findall(word)}
                if parts & _OF_OTHERS:
                    continue
                if parts & _NEVER:
                    return "never"
                if parts & _LAYOUT:
                    told = "layout"
    return told


@dataclass
class Line:
    text: str
    own: int  # characters outside links
    core: bool  # in an article or main element
    kind: str = ""  # "heading", also of a line that the page's title holds, "paragraph" or nothing
    marked: bool = False  # left out by what its markup says


@dataclass
class _Marked:
    """A marked element: the marked one that it is in, its mark, and what it holds."""

    parent: int
    mark: str
    core: bool = False  # an article or main element without a mark
    mass: int = 0
    longest: int = 0
    heading: bool = False


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, those that its markup leaves out marked; the time grows with the page's length, however deep its elements are nested."""
    title = ""
    found: list[tuple[Line, int]] = []
    marked: list[_Marked] = []
    stack: list[tuple[str, int, bool]] = []  # tag, the marked element that it is or is in, whether its text is out
    blocks: list[str] = []
    open_: Counter[str] = Counter()
    text: list[str] = []
    own = 0

    def end() -> None:
        nonlocal own
        if text:
            line = _BLANKS.sub(" ", _html.unescape("".join(text))).strip()
            if line:
                at, out = (stack[-1][1], stack[-1][2]) if stack else (-1, False)
                inner = blocks[-1] if blocks else ""
                kind = "heading" if inner in _HEADINGS or line == title else "paragraph" if inner in _PARAGRAPHS else ""
                found.append((Line(line, own, not out and open_["article"] + open_["main"] > 0, kind, out), at))
                if at >= 0 and not out:
                    e = marked[at]
                    e.mass, e.longest, e.heading = e.mass + own, max(e.longest, own), e.heading or open_["h1"] > 0
            text.clear()
        own = 0

    def pop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        if tag not in _INLINE:
            blocks.pop()
        return tag

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            text.append(piece)
            if not open_["a"]:
                own += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _RAW and not m[1]:
            if not m[3].endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                if tag == "title" and not title:
                    title = _BLANKS.sub(" ", _html.unescape(page[at : stop.start() if stop else len(page)])).strip()
                at = stop.end() if stop else len(page)
            continue
        if tag == "br":
            text.append(" ")
        if tag not in _INLINE:
            end()
        if m[1]:
            while open_[tag] > 0:
                inner = stack[-1]
                if inner[0] not in _INLINE or inner[1] != (stack[-2][1] if len(stack) > 1 else -1) or inner[2] != (len(stack) > 1 and stack[-2][2]):
                    end()
                if pop() == tag:
                    break
            continue
        while blocks and tag not in _INLINE and tag in _CLOSES.get(blocks[-1], ()):
            while pop() in _INLINE:
                pass
        if tag in _VOID:
            continue
        mark, (_, inside, out) = _mark(tag, m[3]), stack[-1] if stack else ("", -1, False)
        if mark and tag in _INLINE:
            end()
        if tag in _CORE and not mark and not out and inside >= 0:
            marked[inside].core = True
        if mark in ("never", "layout") and not out:
            marked.append(_Marked(inside, mark))
            inside = len(marked) - 1
        stack.append((tag, inside, out or mark == "out"))
        open_[tag] += 1
        if tag not in _INLINE:
            blocks.append(tag)
    end()
    gone = _left_out(marked, sum(line.own for line, _ in found if not line.marked))
    for line, at in found:
        line.marked = line.marked or at >= 0 and gone[at]
    return [line for line, _ in found]


def _left_out(marked: list[_Marked], total: int) -> list[bool]:
    """Which marked elements are left out: those in one that is, and all that don't hold the main text.

    An article or main element is taken for that, else, of what only the layout marks, more than half of the page's text with a heading or a paragraph of some length.
    """
    for e in reversed(marked):
        if e.parent >= 0:
            up = marked[e.parent]
            up.core, up.mass, up.longest, up.heading = up.core or e.core, up.mass + e.mass, max(up.longest, e.longest), up.heading or e.heading
    gone: list[bool] = []
    for e in marked:
        holds = e.core or e.mark == "layout" and 2 * e.mass > total and (e.heading or e.longest >= SURGE)
        gone.append(not holds or e.parent >= 0 and gone[e.parent])
    return gone


def level(weight: list[int]) -> int:
    """The largest length that half of the weight stands in lines of at least."""
    total, above = sum(weight), 0
    for w in sorted(weight, reverse=True):
        above += w
        if 2 * above >= total:
            return w
    return 0


def runs_of_text(weight: list[int], kinds: list[str], window: int, share: float, surge: int) -> list[tuple[int, int]]:
    """Where text surges and dives: first line and one past the last, of lines with these weights and kinds."""
    before = [0]
    for w in weight:
        before.append(before[-1] + w)
    n = len(weight)
    sums = [before[min(i + window, n)] - before[i] for i in range(n)]
    least = min(surge, share * level(weight))
    out: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if not weight[i]:
            i += 1
            continue
        first = i
        while i < n and sums[i]:
            i += 1
        heavy = [j for j in range(first, i) if weight[j] >= least]
        if not heavy:
            continue
        start, stop = heavy[0], heavy[-1] + 1
        titled = any(k == "heading" for k in kinds[first:i])
        if titled:  # text begins with the first heading that it follows, not before it
            head = next(j for j in range(first, i) if kinds[j] == "heading")
            if start - head <= window and before[i] - before[head] >= before[head] - before[first]:
                start = head
        plain = not any(kinds[j] == "paragraph" for j in heavy)
        while start > first and weight[start - 1] and kinds[start - 1]:
            start -= 1
        if not titled and plain and start > first and weight[start - 1]:  # a page without headings: the line before the text is one
            start -= 1
        while stop < i and weight[stop] and (plain or kinds[stop]):
            stop += 1
        out.append((start, stop))
    return out


def main_text(page: str, window: int = WINDOW, share: float = SHARE, surge: int = SURGE) -> str:
    """The main text of one page: its blocks joined by line feeds, empty if there is none."""
    shown = lines(page)
    cored = sum(line.own for line in shown if line.core and not line.marked)
    inner = cored > 0 and 2 * cored >= sum(line.own for line in shown if not line.marked)
    usual = level([line.own for line in shown if not line.marked])
    weight = []
    for line in shown:
        out = line.marked or (not line.core if inner else not line.kind and bool(_RIGHTS.match(line.text)))
        weight.append(0 if out else max(len(line.text), usual) if inner else line.own)
    # windows pass over what is marked, which neither ends text nor weighs
    seen = [i for i, line in enumerate(shown) if not line.marked]
    kept: list[str] = []
    for start, stop in runs_of_text([weight[i] for i in seen], [shown[i].kind for i in seen], window, share, surge):
        kept += [shown[i].text for i in seen[start:stop] if weight[i] or not inner and not shown[i].own]
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages.

    Every row gives one, whatever its ids: nulls and repeats stay; an empty table gives none. A null or empty page, or one without main text, has
    empty text. Pages of any length are read whole. Other columns are ignored, whatever their names.
    """

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "html"):
            texts = [main_text(page or "") for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), read, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"))
