"""Main text of web pages by tree scoring.

A page is cut into tags and text once. Furniture (scripts, styles, menus, page headers and footers,
sidebars, notices, adverts, forms, reader comments; by element, role, id or class) is dropped with all it
holds. A container that only an id or class marks may be the layout's wrapper ("has-sidebar"): it stays if it holds
a main element, or an article of at least `sibling` of the page's best points, or, marked by a part of
a word only, more points than what is not marked in the article around it (or on the page, if it has no article elsewhere)
and half of those of the largest such container. What remains is a tree of containers with text blocks. Every block passes points to its container
and half of them to the container above: one, one a comma, and one for each hundred characters, all
discounted by the share of its characters inside links. The container with the most points is in the
article: the outermost article element around it, or else the main element, is kept with every block it
holds, whatever the block's length or score. In a main element around the article, and on the whole page where
there is neither element, everything else stays too but link lists (a quarter or more of the characters inside
links, judged by container and, where that is mixed, by block). Outside an article or main element a
container must also hold `sibling` of the best one's points, if it is no article itself. The blocks, in page
order, are the text: character references decoded, white space inside a block made one space, trimmed,
joined by one line end. Nothing else is dropped or cut.

Defined cases: null or empty html gives an empty text, as does a page without text outside furniture;
unclosed elements, dropped ones too, end where HTML lets their end tag be left out (the next block, item, row
or cell) or else with their container, and an unclosed dropped one before an article or main element; a cut-off tag at the end of the page is markup, not text, and a quote that never closes ends with its tag. Every row gives a row: repeated rows one each,
a null page_id stays null, extra columns are ignored; a very long page is read whole, in a batch of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import in_slices, table

#: HTML element names by what they mean here, and words in ids and classes that mark furniture.
BLOCKS = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th summary legend".split())
CONTAINERS = frozenset("article body center dl div details fieldset figure html main ol section table tbody tfoot thead tr ul".split())
FURNITURE = frozenset("aside button canvas datalist dialog footer form head header iframe input label menu nav noscript object option script search select style svg template textarea title video audio".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|sidebar|rail|widget|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|comment|comments|disqus|reply|replies|respond|pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
#: Words that begin like this mark what an element holds, not how a page is laid out.
_SURELY = re.compile(r"(?:^|\s)(?:comments?|disqus|repl(?:y|ies)|respond|ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|newsletter)(?:$|[\s_-])", re.I)
#: Blocks that can hold others, so that a mark on them may be the layout's; other blocks go with their mark.
_HOLDERS = frozenset("blockquote dd dt li tbody td tfoot th thead tr".split())
_HELD = re.compile(r"<(?:article|main|section|div|p|h[1-6]|ul|ol|dl|table|td|blockquote|pre)(?=[\s/>])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|$)|</[^a-zA-Z>][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
#: A paragraph or list item ends where one of these starts.
_CLOSES_P = BLOCKS | CONTAINERS | FURNITURE | {"hr"} - {"caption"}
#: What the start of an element ends if it is open, and the elements that hide what is open around them from it. All else that starts a block ends a paragraph.
_P_ENDS_AT = frozenset("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre search section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"})}
_ENDS |= dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, {"dl"})) | dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})) | {"tr": ({"tr", "td", "th"}, {"table"})}
_ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}))
_P_HIDDEN_BY = frozenset("td th caption table button object template".split())


def is_furniture(name: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element is dropped with what it holds. An article's own header and labels stay."""
    if name in FURNITURE and not (name in ("header", "label") and inside_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, *value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(value)
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return bool(re.search(r"\shidden(?=\s|$)", attributes))


def mark_of(name: str, attributes: str, inside_article: bool) -> str:
    """Whether an id or class marks an element as furniture: "word" by a whole word or what it surely holds, "part" by a part of a word, or "" (an article: only as a reader's comment)."""
    found = ""
    if attributes and name not in ("html", "body", "main"):
        for key, *value in _ATTRIBUTE.findall(attributes):
            value = "".join(value)
            if key.lower() in ("id", "class") and MARKS.search(value) and not (inside_article and re.fullmatch(r"(?:\S*[\s_-])?header", value, re.I)):
                if _SURELY.search(value) or name != "article" and any(MARKS.fullmatch(x) for x in value.split()):
                    return "word"
                found = "part"
    return "" if name == "article" else found


class Container:
    __slots__ = ("name", "points", "mass", "chars", "linked", "parent", "parts", "unclosed", "mark", "plain", "articles")

    def __init__(self, name: str, parent: Container | None, mark: str = ""):
        self.name, self.parent, self.points, self.parts = name, parent, 0.0, []
        self.unclosed: list[str] = []  # blocks open in it
        self.mark = mark
        self.plain, self.articles = 0.0, 0  # points that no mark within is about; articles with text
        self.mass, self.chars, self.linked = 0.0, 0, 0.0  # points, characters and linked ones of all blocks within


def _finish(pieces: list[str], linked: int, into: Container) -> None:
    text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
    if text:
        density = min(1.0, linked / len(text))
        points = (1 + text.count(",") + len(text) / 100) * (1 - density)
        into.parts.append((text, density, points))


def blocks_of(page: str, sibling: float = 0.2) -> list[str]:
    """The article's blocks in page order."""
    root = Container("", None)
    stack: list[tuple[str, Container]] = []
    here, everything = root, [root]
    pieces: list[str] = []
    linked, in_link, articles, at, n = 0, 0, 0, 0, len(page)
    limits: list[tuple[int, int]] = []  # where marked elements end that end tags do not tell, and their place in the stack
    while at < n:
        m = _TAG.search(page, at)
        for reached in (at, m.start() if m else at):
            if limits and reached >= limits[-1][0]:
                if reached > at:
                    pieces.append(page[at:reached])
                    linked += (reached - at) * in_link
                    at = reached
                _finish(pieces, linked, here)
                pieces, linked, in_link = [], 0, 0
                while limits and reached >= limits[-1][0]:
                    depth = limits.pop()[1]
                    articles -= sum(x == "article" for x, _ in stack[depth:])
                    here = stack[depth][1]
                    del stack[depth:]
        text = page[at : m.start()] if m else page[at:]
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                in_link = 0
            elif name in BLOCKS or name in CONTAINERS or name == "br" or name == "header":
                _finish(pieces, linked, here)
                pieces, linked = [], 0
                if name in here.unclosed:
                    del here.unclosed[len(here.unclosed) - 1 - here.unclosed[::-1].index(name) :]
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if depth is not None:
                    in_link = 0
                    articles -= sum(x == "article" for x, _ in stack[depth:])
                    here = stack[depth][1]
                    del stack[depth:]
                    while limits and limits[-1][1] >= depth:
                        limits.pop()
            continue
        attributes = m[3] or ""
        if name in VOID:
            if name in ("br", "hr", "img", "wbr"):
                pieces.append("" if name == "wbr" else " ")
            continue
        mark = mark_of(name, attributes, articles > 0)
        end = 0
        dropped = name in RAW or is_furniture(name, attributes, articles > 0)
        if mark and not dropped and (name not in CONTAINERS or name in _ENDS):
            end = _end_of(page, at, name, here)
            if attributes.endswith("/") or not (name in _HOLDERS or name not in BLOCKS and _HELD.search(page, at, end)):
                dropped = True
        if dropped:
            if attributes.endswith("/") or name == "head":
                continue
            if name in FURNITURE or name in CONTAINERS or name in BLOCKS:
                _finish(pieces, linked, here)
                pieces, linked = [], 0
                _close(here.unclosed, name)
            at = end or _end_of(page, at, name, here)
            continue
        if end:
            _finish(pieces, linked, here)
            pieces, linked, in_link = [], 0, 0
            _close(here.unclosed, name)
            limits.append((end, len(stack)))
            stack.append(("", here))
            here = Container(name, here, mark)
            everything.append(here)
            here.parent.parts.append(here)
        elif name == "a":
            in_link = 1
        elif name in _CLOSES_P:
            _finish(pieces, linked, here)
            pieces, linked, in_link = [], 0, 0
            _close(here.unclosed, name)
            if name in BLOCKS and name != "blockquote":
                here.unclosed.append(name)
            if name in CONTAINERS or name == "blockquote":
                stack.append((name, here))
                here = Container(name, here, mark)
                everything.append(here)
                here.parent.parts.append(here)
                articles += name == "article"
    _finish(pieces, linked, here)
    if any(c.mark and c.name != "article" for c in everything):
        _drop_marked(everything, sibling)
    return _selected(everything, sibling)


def _around(c: Container) -> Iterator[Container]:
    """The container and those around it, from the inside out."""
    while c is not None:
        yield c
        c = c.parent


def _measure(everything: list[Container]) -> None:
    """Sums of what containers hold; containers stand after the one around them."""
    for c in everything:
        c.points = c.mass = c.plain = c.linked = 0.0
        c.chars = c.articles = 0
    for c in reversed(everything):
        own = [p for p in c.parts if isinstance(p, tuple)]
        points = sum(p[2] for p in own)
        c.points += points
        c.mass += points
        c.plain += points
        c.chars += sum(len(p[0]) for p in own)
        c.linked += sum(len(p[0]) * p[1] for p in own)
        c.articles += c.name in ("article", "main") and not c.mark and c.mass > 0
        if c.parent is not None:
            c.parent.points += points / 2
            c.parent.mass += c.mass
            c.parent.plain += 0 if c.mark and c.name != "article" else c.plain
            c.parent.chars += c.chars
            c.parent.linked += c.linked
            c.parent.articles += c.articles


def _drop_marked(everything: list[Container], sibling: float) -> None:
    """Empties the containers that an id or class marks, but those that are wrappers of the article."""
    _measure(everything)
    inside: set[int] = set()  # containers in a marked one
    best = 0.0
    for c in everything:
        if c.mark and c.name != "article" or id(c.parent) in inside:
            inside.add(id(c))
        if id(c) not in inside:
            best = max(best, c.points)
        if c.name in ("article", "main") and not c.mark:
            best = max(best, c.mass)
    kept: set[int] = set()
    for c in everything:
        if c.name == "main" and c.mass > 0 or c.name == "article" and not c.mark and c.mass > 0 and c.mass >= sibling * best:
            around = c.parent
            while around is not None and id(around) not in kept:
                kept.add(id(around))
                around = around.parent
    marked = [c for c in everything if c.mark and c.name != "article"]
    for c in marked:
        if id(c) in kept:
            c.mark = ""
        elif c.mark == "word":
            c.parts = []
    _measure(everything)
    undecided = [c for c in marked if c.mark == "part" and c.mass > 0]
    half = 0.5 * max((c.plain for c in undecided), default=0.0)
    page = everything[0]
    scopes = {id(page): page}  # the article around, or the page
    gone: set[int] = set()
    for c in everything[1:]:
        scope = scopes[id(c.parent)]
        scopes[id(c)] = c if c.name in ("article", "main") and not c.mark else scope
        if id(c.parent) in gone:
            gone.add(id(c))
        elif c.mark == "part" and c.mass > 0:
            if c.mass > scope.plain and c.mass >= half and (scope is not page or page.articles == c.articles):
                c.mark = ""
                while scope is not page:
                    scope.plain += c.plain
                    scope = scopes[id(scope.parent)]
                page.plain += c.plain
            else:
                gone.add(id(c))
    for c in marked:
        if c.mark:
            c.parts = []


def _selected(everything: list[Container], sibling: float) -> list[str]:
    """The article's blocks."""
    _measure(everything)
    best = max(everything, key=lambda c: c.points)
    if best.points <= 0:
        best = max(everything, key=lambda c: sum(len(p[0]) for p in c.parts if isinstance(p, tuple)))
    while best.parent is not None and best.parent.points > best.points * 0.9:
        best = best.parent
    around = list(_around(best))
    main = next((c for c in reversed(around) if c.name == "main"), None)
    frame = next((c for c in reversed(around) if c.name == "article"), main or best)
    marked_off = frame.name in ("article", "main")
    least = max(2.0, sibling * best.points)
    path = set(map(id, _around(frame)))
    out: list[str] = []
    # A part with the part of the page that it is in: "outside" an article or main element, in the "open", "whole" (all is kept)
    todo = [(everything[0], "outside" if marked_off else "open")]
    while todo:
        part, place = todo.pop()
        if isinstance(part, tuple):
            if place == "whole" or part[1] < 0.25:
                out.append(part[0])
            continue
        if part is frame:
            place = "whole"
        elif part is main:
            place = "open"
        elif id(part) not in path and place != "whole":
            if place == "outside" and part.mass < least and part.name not in ("article", "main"):
                continue
            place = "whole" if part.linked < 0.25 * part.chars else "open"
        todo += [(x, place) for x in reversed(part.parts)]
    return out


def _close(names: list[str], name: str) -> None:
    """Takes the open elements off that the start of an element ends."""
    if name in _P_ENDS_AT:
        _close_any(names, {"p"}, _P_HIDDEN_BY)
    if name in _ENDS:
        _close_any(names, *_ENDS[name])


def _close_any(names: list[str], ended: set[str], hidden_by: set[str]) -> None:
    first = None
    for k in range(len(names) - 1, -1, -1):
        if names[k] in hidden_by:
            break
        if names[k] in ended:
            first = k
    if first is not None:
        del names[first:]


def _end_of(page: str, at: int, name: str, here: Container) -> int:
    """Where a dropped element of the container ends: with its own end tag, else where HTML lets it be left out, else before the end tag of what is open around it."""
    if name in RAW:
        m = _END[name].search(page, at)
        if m:
            return page.find(">", m.end()) + 1 or len(page)
        if name in ("script", "style", "textarea", "title", "iframe"):
            return len(page)
    names = [x for c in reversed(list(_around(here))) for x in (c.name, *c.unclosed)]
    outer, text = len(names), -1  # text: where an article starts
    names.append(name)
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or tag in VOID and tag != "hr":
            continue
        if m[1]:
            k = next((k for k in range(len(names) - 1, -1, -1) if names[k] == tag), -1)
            if k == outer:
                return at
            if 0 <= k < outer:
                return m.start() if text < 0 else text
            if k > 0:
                del names[k:]
            continue
        if tag in ("article", "main") and text < 0:
            text = m.start()
        _close(names, tag)
        if len(names) <= outer:
            return m.start()
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else at if tag in ("noscript", "template", "svg") else len(page)
        elif tag != "hr":
            names.append(tag)
    return len(page) if text < 0 else text


def main_text(page: str | None) -> str:
    return "\n".join(blocks_of(page)) if page else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; a narrow operation, no shuffle."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLE_SQL: dict[str, str] = {}
