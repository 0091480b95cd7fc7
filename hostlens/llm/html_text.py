"""HTML extraction by layout: all visible text, with block spacing, lists and aligned table cells.

A tokenizer feeds a stack of open elements that closes what HTML's rules imply (paragraphs before
blocks, list items, table parts, the head). Text goes into the flow of the innermost open table cell,
or of the page; a table is laid out when it closes. Nothing recurses, so nesting may be of any depth.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_IN_TAG = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_BLANK = re.compile(r"[ \t\n\f\r]+")
_WATCHED = re.compile(r"hidden|style|start|type|span", re.I)

#: Elements by what HTML says of them.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript noembed noframes iframe object audio video canvas datalist".split())
#: Of these, text within an svg element is not drawn.
UNDRAWN = frozenset("defs desc metadata symbol".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl pre blockquote table figure article section".split())
LINE = CLOSES_P | frozenset("body html tr td th thead tbody tfoot caption option optgroup legend select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table td th caption html template".split())
CELLS = frozenset(("td", "th"))
TABLE_PARTS = frozenset("table tr td th thead tbody tfoot caption".split())
WIDEST = 40
#: Tables nested deeper than this are laid out as blocks, a cell under another, so that no line is padded again at each level.
DEEPEST = 8
#: Times the text of a row that its aligned lines may take, beside FREE characters that any row has.
SPREAD, FREE = 8, 2000


class Flow:
    """Lines of text: inline pieces are joined and their blanks collapsed; blocks ask for line breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.marker: str | None = None
        self.indent = ""

    def text(self, text: str, keep: bool) -> None:
        self.parts.append(text if keep else _BLANK.sub(" ", text))

    def end_line(self, gap: int = 1, keep: bool = False) -> None:
        if self.parts:
            line = "".join(self.parts)
            self.parts = []
            self._put(line.strip("\n") if keep else re.sub(" {2,}", " ", line).strip(" "))
        self.gap = max(self.gap, gap)

    def _put(self, line: str) -> None:
        if not line.strip():
            return
        if self.lines and self.gap > 1:
            self.lines.append("")
        first = self.indent if self.marker is None else self.indent[: len(self.indent) - len(self.marker)] + self.marker
        self.lines += [(first if i == 0 else self.indent) + x for i, x in enumerate(line.split("\n"))]
        self.marker, self.gap = None, 0

    def block(self, lines: list[str]) -> None:
        self.end_line(2)
        self._put("\n".join(lines))
        self.gap = 2

    def result(self) -> str:
        self.end_line()
        return "\n".join(x.rstrip() for x in self.lines)


class Table:
    def __init__(self) -> None:
        self.rows: list[list[str]] = []

    def lines(self) -> list[str]:
        """Rows with their cells aligned; a cell's lines stand under one another, cells over 40 wide push the rest.

        A row that would be blank for the most part, as one cell is tall and many are beside it, has its cells one
        under another, so that lines never take over SPREAD times the text of their row.
        """
        columns = max((len(r) for r in self.rows), default=0)
        if columns <= 1:
            return [x for r in self.rows for c in r for x in c.split("\n") if x]
        cells = [[c.split("\n") for c in r] for r in self.rows if any(r)]
        widths = [min(WIDEST, max((len(x) for r in cells if k < len(r) for x in r[k]), default=0)) for k in range(columns)]
        out = []
        for row in cells:
            height, across = max(len(c) for c in row), sum(widths[: len(row)]) + 3 * len(row)
            if height * across > SPREAD * (sum(len(x) + 1 for c in row for x in c) + FREE):
                out += [x for c in row for x in c if x]
                continue
            for i in range(height):
                out.append(" | ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(row, widths)).rstrip())
        return out


class Page:
    """Open elements and the flow that text goes to."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, object]] = []
        #: Where the elements of each name stand among the open ones.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.unseen = 0
        self.flows = [Flow()]
        self.tables: list[Table | None] = []
        self.lists: list[list] = []

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def pop(self) -> None:
        name, hidden, kept = self.open.pop()
        self.places[name].pop()
        if not self.unseen:
            if name in CELLS and kept:
                cell = self.flows.pop().result()
                rows = self.tables[-1].rows
                (rows or rows.append([]) or rows)[-1].extend([cell] + [""] * (kept[0] - 1))
            elif name == "table" and kept:
                table = self.tables.pop()
                lines = table.lines() if table else []
                if lines:
                    self.flow.block(lines)
                elif table is None:
                    self.flow.end_line(2)
            elif name in ("ul", "ol", "menu") and kept:
                self.lists.pop()
                self.flow.end_line(1 if self.lists else 2)
            elif name == "li" and kept:
                self.flow.end_line()
                self.flow.marker, self.flow.indent = None, kept[0]
            elif name == "pre":
                self.flow.end_line(2, keep=True)
            elif name in SPACED:
                self.flow.end_line(2)
            elif name in LINE:
                self.flow.end_line()
        if hidden:
            self.unseen -= 1

    def innermost(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of `names`, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def pop_to(self, names: Iterable[str], stop: Iterable[str]) -> bool:
        """Closes the innermost open element of `names`, unless one of `stop` (and not of `names`) is opened within."""
        at = self.innermost(names)
        if at < 0 or self.innermost(n for n in stop if n not in names) > at:
            return False
        while len(self.open) > at:
            self.pop()
        return True

    def imply(self, name: str) -> None:
        if self.places["head"] and name not in IN_HEAD and name != "head":
            self.pop_to(("head",), ())
        if name in CLOSES_P:
            self.pop_to(("p",), SCOPE)
        if name in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        if name == "li":
            self.pop_to(("li",), SCOPE | {"ul", "ol", "menu"})
        elif name in ("dt", "dd"):
            self.pop_to(("dt", "dd"), SCOPE | {"dl"})
        elif name in ("option", "optgroup"):
            self.pop_to(("option",), SCOPE | {"select"})
        elif name in CELLS:
            self.pop_to(CELLS, ("table", "tr"))
        elif name == "tr":
            self.pop_to(("tr",), ("table",)) or self.pop_to(CELLS, ("table",))
        elif name in ("thead", "tbody", "tfoot", "caption"):
            self.pop_to(("thead", "tbody", "tfoot", "caption"), ("table",)) or self.pop_to(("tr",), ("table",))

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self.imply(name)
        if name == "br":
            if not self.unseen:
                self.flow.end_line(0)
                self.flow.gap = max(self.flow.gap, 1)
            return
        if name in EMPTY:
            if name == "hr" and not self.unseen:
                self.flow.end_line(2)
            return
        style = re.sub(r"\s", "", attributes.get("style", "")).lower()
        hidden = name in UNSEEN or "hidden" in attributes or "display:none" in style or "visibility:hidden" in style or (name in UNDRAWN and bool(self.places["svg"]))
        self.unseen += hidden
        kept: object = None
        if not self.unseen:
            flow = self.flow
            if name in ("ul", "ol", "menu"):
                flow.end_line(1 if self.lists else 2)
                begin = attributes.get("start", "1")
                kept = self.lists.append([name == "ol", int(begin) if re.fullmatch(r"-?\d{1,9}", begin) else 1]) or True
            elif name == "li":
                flow.end_line()
                kept = (flow.indent,)
                number = self.lists[-1] if self.lists else [False, 0]
                flow.marker = f"{number[1]}. " if number[0] else "- "
                number[1] += 1
                flow.indent += " " * len(flow.marker) if len(flow.indent) < 40 else ""
                flow.marker = flow.marker if len(flow.indent) >= len(flow.marker) else None
            elif name == "table":
                flow.end_line(2)
                kept = self.tables.append(Table() if len(self.tables) < DEEPEST else None) or True
            elif name == "tr" and self.tables and self.tables[-1]:
                self.tables[-1].rows.append([])
            elif name in CELLS and self.tables and self.tables[-1]:
                span = attributes.get("colspan", "1")
                kept = (min(100, max(1, int(span))) if re.fullmatch(r"\d{1,4}", span) else 1,)
                self.flows.append(Flow())
            elif name in SPACED:
                flow.end_line(2)
            elif name in LINE:
                flow.end_line()
        self.open.append((name, bool(hidden), kept))
        self.places[name].append(len(self.open) - 1)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        elif name == "p" and not self.pop_to(("p",), SCOPE):
            if not self.unseen:
                self.flow.end_line(2)
        elif name in HEADINGS:
            self.pop_to(HEADINGS, SCOPE)
        elif name == "li":
            self.pop_to(("li",), SCOPE | {"ul", "ol", "menu"})
        elif name == "table":
            self.pop_to(("table",), ())
        elif name in TABLE_PARTS:
            self.pop_to((name,), ("table",))
        elif name not in ("body", "html", "p"):
            self.pop_to((name,), SCOPE)

    def text(self, text: str, literal: bool = False) -> None:
        if self.open and self.open[-1][0] == "head" and text.strip():
            self.pop()
        if self.unseen:
            return
        self.flow.text(html.unescape(text) if "&" in text and not literal else text, bool(self.places["pre"]))

    def result(self) -> str:
        while self.open:
            self.pop()
        return self.flow.result()


class Tags:
    """Where the tags of a page end. What was gone through once is not gone through again, so hostile pages take linear time."""

    def __init__(self, source: str):
        self.source = source
        self.ends: dict[int, int] = {}
        self.last = {c: source.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """The place of the > that ends a tag, from within it: the first outside quotes, or else the first; -1 without any."""
        met, i = [], at
        while True:
            token = _IN_TAG.search(self.source, i) if i <= max(self.last.values()) else None
            if token is None:
                end = -1
                break
            if token.start() in self.ends:
                end = self.ends[token.start()]
                break
            met.append(token.start())
            if token[0] == ">":
                end = token.start()
                break
            if self.last[token[0]] <= token.start():  # the quote never closes
                end = -1
                break
            i = self.source.index(token[0], token.end()) + 1
        for place in met:
            self.ends[place] = end
        if end < 0 and self.last[">"] >= at:
            end = self.source.index(">", at)
        return end


def visible_text(source: str | None) -> str:
    page, at, shown = Page(), 0, 0
    source = source or ""
    tags = Tags(source)

    def before(place: int) -> None:
        if place > shown:
            page.text(source[shown:place])

    while True:
        at = source.find("<", at)
        if at < 0:
            break
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            before(at)
            at = shown = end + 3 if end >= 0 else len(source)
            continue
        tag = _TAG.match(source, at + 1)
        end = tags.end(tag.end()) if tag else -1
        if tag is None and source[at + 1 : at + 2] in ("!", "?", "/") and tags.last[">"] > at:
            before(at)
            at = shown = source.index(">", at) + 1
            continue
        if end < 0:
            at += 1
            continue
        before(at)
        rest = source[tag.end() : end]
        at = shown = end + 1
        name = tag[2].lower()
        if tag[1]:
            page.end(name)
            continue
        attributes = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest)} if rest and _WATCHED.search(rest) else {}
        page.start(name, attributes)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            end = close.start() if close else len(source)
            if name not in UNSEEN and end > at:
                page.text(source[at:end], literal=name == "xmp")
            at = shown = end
    before(len(source))
    return page.result()


def extracted(text: Column) -> Column:
    small_batches()

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([visible_text(x) for x in batch], dtype=object)

    return of(text)


def pages_text(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_lines.

    A null or empty page has an empty text. Rows alike each have their row; an empty table gives none.
    Unclosed comments end where the page ends; an unclosed tag is text. Time and text grow in proportion to
    the page, whatever it nests or leaves open: a row of a table whose lines would be blank for the most part,
    and tables nested over 8 deep, are laid out as blocks, and a cell spans at most 100 columns; no text is lost.
    """
    rows = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return rows.withColumn("n_lines", lines.cast("int"))
