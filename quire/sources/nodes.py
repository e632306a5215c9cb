"""Web pages as a table of nodes: one row an element or text, numbered in page order, with the number of the last node inside it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from quire.sources.common import parsed

#: Elements without content, elements whose content is no markup, and what the start of an element ends if it is open (up to the elements that hide it).
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noframes iframe xmp".split())
_ENDS_P = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li dt dd main menu nav ol p pre section summary table ul".split()
_ENDS = {
    **{name: ({"p"}, {"button", "table", "td", "th", "li", "dd", "dt", "caption", "object"}) for name in _ENDS_P},
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "th", "table"}), "button": ({"button"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: An end tag does not close an element outside the cell or table that it stands in; those of a table's own parts go as far as their table.
_WALLS = frozenset({"td", "th", "caption", "table"})
_END_WALLS = {"table": frozenset()} | dict.fromkeys(("td", "th", "caption", "tr", "tbody", "thead", "tfoot"), frozenset({"table"}))
_NAME, _VALUE = r"[^\s/>=][^\s/>=]*+", r"(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)"
_TAG = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/|=|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)>", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*=\s*({_VALUE}))?")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
NODE = "id int, last int, depth int, parent int, control int, name string, attrs map<string,string>, text string"
CONTROLS = ("a", "button")


def attributes(written: str) -> dict[str, str]:
    """The attributes of a tag, lower-cased, references decoded; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(written):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def _walked(page: str) -> Iterator[tuple]:
    """NODE rows of one page: no recursion, an element without an end tag ends with what holds it or where HTML ends it."""
    rows: list[list] = []
    open_: list[int] = []  # numbers of the open elements
    at = 0

    def close(depth: int) -> None:
        for k in open_[depth:]:
            rows[k][1] = len(rows) - 1
        del open_[depth:]

    def innermost(names: frozenset | set, walls: frozenset | set) -> int | None:
        for depth in range(len(open_) - 1, -1, -1):
            name = rows[open_[depth]][5]
            if name in names:
                return depth
            if name in walls:
                return None
        return None

    def add(name: str | None, attrs: dict | None, text: str | None) -> None:
        above = open_[-1] if open_ else None
        control = None if above is None else above if rows[above][5] in CONTROLS else rows[above][4]
        rows.append([len(rows), len(rows), len(open_), above, control, name, attrs, text])

    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            add(None, None, html.unescape(text))
        if not m:
            break
        at = m.end()
        ends, name = m[1], (m[2] or "").lower()
        if not name:
            continue
        if ends:
            depth = innermost({name}, _END_WALLS.get(name, _WALLS))
            if depth is not None:
                close(depth)
            continue
        if name in _ENDS and (depth := innermost(*_ENDS[name])) is not None:
            close(depth)
        add(name, attributes(m[3]) if m[3].strip("/ ") else {}, None)
        if name in RAW:
            found = _END[name].search(page, at)
            stop = found.start() if found else len(page)
            open_.append(len(rows) - 1)
            if stop > at:
                add(None, *((None, html.unescape(page[at:stop])) if name in ("title", "textarea") else ({"raw": ""}, page[at:stop])))
            close(len(open_) - 1)
            at = page.find(">", stop) + 1 or len(page)
        elif name not in VOID:
            open_.append(len(rows) - 1)
    close(0)
    return iter([tuple(r) for r in rows])


def nodes(pages: DataFrame, column: str = "html", doc: str = "doc") -> DataFrame:
    """(doc, id, last, depth, parent, control, name, attrs, text, error): elements and texts of every page in order.

    The nodes inside a node are those from id + 1 to last. control is the innermost link or button around a node; name is
    null for a text, whose attrs hold `raw` if it is no markup (scripts, styles). Comments and declarations are no nodes.
    """
    return parsed(pages, column, NODE, _walked, doc=doc)
