"""XML as rows of tokens: elements matched by running sums, and outlines; texts laid out and elements picked by name where a text stands.

A text is cut into tokens by one pattern and numbered. The level of a tag is a running sum of starts and ends, an element
ends at the next tag of its level, and its parent is the last start on the level above; so nesting costs no recursion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.sources.common import parsed

TOKEN = r"<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<!(?i:DOCTYPE)[^>\[]*(?:\[[\s\S]*?\])?\s*>|</?[A-Za-z_:][^>]*>|[^<]+|<"
#: The references of XML.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    """Text with the five references of XML and those by number resolved."""
    numbered = F.regexp_extract_all(text, F.lit(r"&#x[0-9a-fA-F]{1,6};|&#[0-9]{1,7};|[^&]+|&"), F.lit(0))
    code = lambda t: F.when(t.startswith("&#x"), F.conv(F.substring(t, 4, 6), 16, 10)).otherwise(F.regexp_extract(t, r"([0-9]+)", 1)).try_cast("int")
    utf8 = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    text = F.when(text.contains("&#"), F.array_join(F.transform(numbered, lambda t: F.when(t.startswith("&#"), utf8(code(t))).otherwise(t)), "")).otherwise(text)
    for reference, plain in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return text


def _in_order(*more: str) -> WindowSpec:
    return Window.partitionBy("doc", *more).orderBy("pos")


def tokens(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, pos, token, kind, name): kinds are open, close, alone (an element without content), text, data (CDATA) and other (comments, instructions, doctype)."""
    cut = df.select(F.col(doc).cast("string").alias("doc"), F.posexplode(F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.col("token").rlike(r"^</?[A-Za-z_:]") & F.col("token").endswith(">")
    kind = (
        F.when(F.col("token").rlike(r"^<!(?i:\[CDATA\[)"), "data").when(F.col("token").rlike(r"^<[?!]") & (F.length("token") > 1), "other").when(~tag, "text")
        .when(F.col("token").startswith("</"), "close").when(F.col("token").endswith("/>"), "alone").otherwise("open")
    )
    named = F.when(F.col("kind").isin("open", "close", "alone"), F.regexp_extract("token", r"^</?\s*([^\s/>]+)", 1))
    return cut.withColumn("kind", kind).withColumn("name", named)


def leveled(tokens: DataFrame) -> DataFrame:
    """tokens with level (1 for the outermost nodes), end (pos of an element's end tag, its own for other nodes, null if tags do not match) and parent (pos of the start tag around it)."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    deep = tokens.withColumn("level", (F.sum(step).over(_in_order()) + F.when(F.col("kind") == "open", 0).otherwise(1)).cast("int"))
    tag = F.col("kind").isin("open", "close")
    beside = Window.partitionBy("doc", "level", tag).orderBy("pos")
    fits = (F.lead("kind").over(beside) == "close") & (F.lead("name").over(beside) == F.col("name"))
    ended = deep.withColumn("end", F.when(F.col("kind") == "open", F.when(fits, F.lead("pos").over(beside))).otherwise(F.col("pos")))
    # Every token stands once as what it is, and every start once more as what the nodes one level up may be in.
    both = ended.withColumn("_key", F.col("level") - 1).withColumn("_start", F.lit(None).cast("int")).unionByName(ended.where("kind = 'open'").withColumn("_key", F.col("level")).withColumn("_start", F.col("pos")))
    inside = both.withColumn("parent", F.last("_start", ignorenulls=True).over(_in_order("_key")))
    return inside.where("_start is null").drop("_key", "_start")


_CUT = re.compile(TOKEN, re.ASCII)
_NAME = re.compile(r"</?\s*([^\s/>]+)", re.ASCII)
_KEEPS = re.compile(r"\bxml:space\s*=\s*[\"']preserve[\"']", re.ASCII)
_SPACE = " \t\n\x0b\f\r"


def _kind(token: str) -> str:
    """The kind of a token, as tokens() has it."""
    if token[0] != "<" or len(token) == 1:
        return "text"
    if token[1] in "!?":
        return "data" if token[:9].upper() == "<![CDATA[" else "other"
    if token[-1] != ">":
        return "text"
    return "close" if token[1] == "/" else "alone" if token[-2] == "/" else "open"


def _laid_out(text: str) -> str | None:
    """A text with elements that hold only markup broken over lines; None where tags do not match or text stands outside of them."""
    each = [(token, _kind(token)) for token in _CUT.findall(text)]
    # What each element holds, and where it ends, by the elements around a token.
    end, speaks, holds, opened = {}, set(), set(), []
    for pos, (token, kind) in enumerate(each):
        if kind == "close":
            if not opened or opened[-1][1] != _NAME.match(token)[1]:
                return None
            end[opened.pop()[0]] = pos
            continue
        if kind == "data" or kind == "text" and token.strip(_SPACE):
            if opened:
                speaks.add(opened[-1][0])
            elif kind == "text":
                return None
        elif kind != "text" and opened:
            holds.add(opened[-1][0])
        if kind == "open":
            opened.append((pos, _NAME.match(token)[1]))
    if opened:
        return None
    parts, level, copied_to = [], 0, -1
    for pos, (token, kind) in enumerate(each):
        level -= kind == "close"
        if pos <= copied_to:
            parts.append(token)
        elif kind != "text":
            parts.append("\n" + "  " * level + token)
            if kind == "open" and (pos not in holds or pos in speaks or _KEEPS.search(token)):
                copied_to = end[pos]
        level += kind == "open"
    return "".join(parts).removeprefix("\n")


def reindented(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, xml): elements that hold only markup are broken over lines, two spaces a level; all others are copied as they are.

    So are elements with xml:space="preserve". Null where tags do not match or text stands outside of them. Every document has a row.
    A text is laid out where it stands: its tokens, many times its size as rows, are not shuffled."""
    filled = df.select(F.col(doc).alias("doc"), F.coalesce(column, F.lit("")).alias("text"))
    return parsed(filled, "text", "xml string", lambda t: [(_laid_out(t),)]).select("doc", "xml")


def _elements(text: str, names: list[str]) -> Iterator[tuple[int, str, str]]:
    """(pos, name, inner) of the outermost elements of some names."""
    each = _CUT.findall(text)
    wanted, ends, levels, begun = [], {}, dict.fromkeys(names, 0), {}
    for pos, token in enumerate(each):
        kind = _kind(token)
        if kind not in ("open", "close", "alone"):
            continue
        named = _NAME.match(token)
        name = named[1] if named else ""
        if name not in levels:
            continue
        if kind == "close":
            levels[name] -= 1
            start = begun.pop((name, levels[name]), None)
            if start is not None:
                ends[start] = pos
            continue
        wanted.append((pos, name))
        if kind == "alone":
            ends[pos] = pos
        else:
            begun[name, levels[name]] = pos
            levels[name] += 1
    reach = -1
    for pos, name in wanted:
        if pos > reach:
            yield pos, name, "".join(each[pos + 1 : ends.get(pos, len(each))])
        reach = max(reach, ends.get(pos, len(each)))


def elements(df: DataFrame, names: list[str], column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, pos, name, inner): the outermost elements of some names, in order; one that never ends goes on to the end of its text.

    Starts and ends are counted for each name by itself, so that other tags need not match."""
    return parsed(df, column, "pos int, name string, inner string", lambda t: _elements(t, names), doc=doc).select("doc", "pos", "name", "inner")


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, references resolved; null without it."""
    pattern = rf"^<[^\s/>]+(?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*?\s+{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.when(tag.rlike(pattern), decoded(F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))))


def outlines(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, title, n, parent, depth, text, link, note): the items of OPML outlines in order; parent is the n of the item around one.

    Text is `text`, else `title`; the link is the first of htmlUrl, url and xmlUrl that is a web or mail address. A document that is no outline has no rows."""
    t = tokens(df, column, doc).withColumn("name", F.lower("name"))
    t = t.withColumn("_opml", F.max((F.col("name") == "opml") & (F.col("kind") == "open")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    items = t.where("_opml and name = 'outline'")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    items = items.withColumn("depth", (F.sum(step).over(_in_order()) + F.when(F.col("kind") == "open", 0).otherwise(1)).cast("int")).where("kind <> 'close'")
    items = items.withColumn("n", (F.row_number().over(_in_order()) - 1).cast("int"))
    above = items.where("kind = 'open'").select("doc", F.col("depth").alias("_key"), "pos", F.col("n").alias("_n"), F.lit(True).alias("_above"))
    each = items.select("*", (F.col("depth") - 1).alias("_key")).withColumn("_above", F.lit(False)).unionByName(above, allowMissingColumns=True)
    inside = each.withColumn("parent", F.last("_n", ignorenulls=True).over(_in_order("_key"))).where("not _above")
    links = F.filter(F.array(*[F.trim(attribute(F.col("token"), a)) for a in ("htmlUrl", "url", "xmlUrl")]), lambda u: u.rlike(r"(?i)^(https?:|mailto:)"))
    rows = inside.select("doc", "n", "parent", "depth", F.coalesce(attribute(F.col("token"), "text"), attribute(F.col("token"), "title"), F.lit("")).alias("text"), F.try_element_at(links, F.lit(1)).alias("link"), attribute(F.col("token"), "_note").alias("note"))
    heads = elements(df, ["head"], column, doc).groupBy("doc").agg(F.min_by("inner", "pos").alias("head"))
    title = elements(heads, ["title"], "head").groupBy("doc").agg(F.trim(decoded(F.min_by("inner", "pos"))).alias("title"))
    return rows.join(title, "doc", "left").select("doc", "title", "n", "parent", "depth", "text", "link", "note")
