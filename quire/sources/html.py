"""Web pages as blocks and as table cells. The page is parsed once; order is a column."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from quire.sources.common import parsed

#: Elements of a block each, elements without an end, and those whose content is no text.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd figcaption hr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template title head noscript".split())
MOST_SPAN = 1000


class _Tree(HTMLParser):
    """Collects blocks and tables in one walk; an unclosed element ends with what holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.tables: list[list[list[tuple[str, int, int, bool]]]] = []
        self.open: list[tuple[int, list | None]] = []  # tables being read: number, the cell's parts
        self.silent, self.block, self.lists, self.spans = 0, None, 0, (1, 1, False)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append([len(self.tables) - 1, None])
        elif tag == "tr" and self.open:
            self._end_cell()
            self.tables[self.open[-1][0]].append([])
        elif tag in ("td", "th") and self.open:
            self._end_cell()
            if not self.tables[self.open[-1][0]]:
                self.tables[self.open[-1][0]].append([])
            a = dict(attrs)
            span = lambda k: min(MOST_SPAN, max(1, int(a.get(k) or 1))) if str(a.get(k) or 1).isdigit() else 1
            self.open[-1][1] = []
            self.spans = (span("rowspan"), span("colspan"), tag == "th")
        elif tag in BLOCKS and not self.open:
            self._end_block()
            self.block = [tag, int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else self.lists, []]
            if tag == "hr":
                self._end_block(keep=True)
        elif tag in ("ul", "ol"):
            self.lists += 1
        elif tag == "br":
            self.handle_data("\n" if not self.open else " ")
        if self.open and (tag in BLOCKS or tag == "div"):
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.open:
            self._end_cell()
            self.open.pop()
            self.handle_data(" ")
        elif tag in ("td", "th", "tr") and self.open:
            self._end_cell()
        elif tag in BLOCKS and not self.open:
            self._end_block()
        elif tag in ("ul", "ol"):
            self.lists = max(0, self.lists - 1)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.open:
            if self.open[-1][1] is not None:
                self.open[-1][1].append(data)
        elif self.block is not None:
            self.block[2].append(data)
        elif data.strip():
            self.block = ["p", 0, [data]]

    def _end_block(self, keep: bool = False) -> None:
        if self.block is not None:
            tag, level, parts = self.block
            text = "".join(parts) if tag == "pre" else " ".join("".join(parts).split())
            if text.strip() or keep:
                self.blocks.append([tag, level, text])
        self.block = None

    def _end_cell(self) -> None:
        number, parts = self.open[-1]
        if parts is not None:
            self.tables[number][-1].append((" ".join("".join(parts).split()), *self.spans))
        self.open[-1][1] = None

    def read(self, html: str) -> _Tree:
        self.feed(html)
        self.close()
        while self.open:
            self.handle_endtag("table")
        self._end_block()
        return self


def _grid(rows: list, fill: bool) -> list[list[tuple[str, bool]]]:
    """Rows with their spans written out and padded to one width; a spanned value is repeated if fill, else only its first cell has it."""
    held: dict[tuple[int, int], tuple[str, bool]] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across, head in row:
            while (r, c) in held:
                c += 1
            for i in range(min(down, len(rows) - r)):
                for j in range(across):
                    held[r + i, c + j] = (text if i == j == 0 or fill and j == 0 else "", head)
            c += across
    width = max((c for _, c in held), default=-1) + 1
    return [[held.get((r, c), ("", False)) for c in range(width)] for r in range(len(rows))]


def _cells(html: str, fill: bool) -> Iterator[tuple]:
    number = 0
    for rows in _Tree().read(html).tables:
        grid = [row for row in _grid(rows, fill)]
        if any(text for row in grid for text, _ in row):
            for r, row in enumerate(grid):
                for c, (text, head) in enumerate(row):
                    yield number, r, c, head, text
            number += 1


def blocks(pages: DataFrame, column: str = "html", doc: str = "doc") -> DataFrame:
    """(doc, pos, tag, level, text, error): paragraphs, headings, list items and rules outside tables, in order."""
    return parsed(pages, column, "pos int, tag string, level int, text string", lambda h: ((k, *b) for k, b in enumerate(_Tree().read(h).blocks)), doc=doc)


def cells(pages: DataFrame, column: str = "html", doc: str = "doc", *, fill_rowspans: bool = True) -> DataFrame:
    """(doc, table_no, r, c, is_header, value, error): every table that is not blank, nested ones for themselves, with spans written out."""
    return parsed(pages, column, "table_no int, r int, c int, is_header boolean, value string", lambda h: _cells(h, fill_rowspans), doc=doc)
