"""Pages rewritten over their node table: what is hidden or not allowed goes, links and pictures are set right, html is written again.

A subtree is a range of node numbers, so what is inside a dropped element is found by a running maximum over the
page's order, what an element holds by the difference of two running sums, and a page is written by bringing start
and end tags into order. Nothing walks a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import text, url

#: Elements and attributes that a document keeps, elements that go with all they hold, and address schemes.
KEPT = "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th pre code blockquote hr img a strong b em i u s br sup sub mark span div aside".split()
ATTRIBUTES = {"a": ["href", "title"], "img": ["src", "alt", "width", "height"], "td": ["colspan", "rowspan", "style"], "th": ["colspan", "rowspan", "style"], "code": ["class"], "pre": ["class"], "sup": ["data-fn"], "li": ["data-fn"], "mark": ["style"]}
SILENT = "script style textarea option title head noframes".split()
SCHEMES, PICTURE_SCHEMES = ["http", "https", "mailto"], ["data", "http", "https"]
#: Languages of code that are drawn, by the name that they get.
DRAWN = {"mermaid": "mermaid", "dot": "dot", "graphviz": "dot", "gv": "dot", "viz": "dot", "math": "math"}
WRITTEN_ALONE = "area base basefont br col embed hr img input link meta".split()
#: Classes of text for screen readers only.
HIDDEN_CLASSES = "sr-only visually-hidden visuallyhidden screen-reader-text screen-reader-only assistive-text element-invisible ms-hidden ms-cui-hidden".split()



def _to_here() -> WindowSpec:
    """A node and all before it on its page."""
    return Window.partitionBy("doc").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def inside(condition: Column) -> Column:
    """Whether a node is one that meets a condition, or is inside one."""
    return F.coalesce(F.max(F.when(condition, F.col("last"))).over(_to_here()) >= F.col("id"), F.lit(False))


def without(nodes: DataFrame, condition: Column) -> DataFrame:
    """nodes without those that meet a condition and all they hold."""
    return nodes.withColumn("_gone", inside(condition)).where("not _gone").drop("_gone")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def without_attrs(*names: str) -> Column:
    return F.map_filter("attrs", lambda k, v: ~k.isin(*names))


def with_attr(name: str, value: Column) -> Column:
    """attrs with one value set in place; null removes it."""
    changed = F.transform_values("attrs", lambda k, v: F.when(k == name, value).otherwise(v))
    return F.map_filter(changed, lambda k, v: v.isNotNull())


def visible(nodes: DataFrame) -> DataFrame:
    """nodes that a browser paints, or that only start collapsed.

    Gone for good: aria-hidden, classes for screen readers, boxes of one pixel that are clipped. Gone unless they hold a heading, a
    table or two paragraphs: the hidden attribute (but `until-found`), display: none and visibility: hidden.
    """
    style = F.lower(F.regexp_replace(F.coalesce(attr("style"), F.lit("")), r"\s+", ""))
    classes = F.split(F.lower(F.coalesce(attr("class"), F.lit(""))), r"\s+")
    clipped = style.contains("width:1px") & style.contains("height:1px") & style.rlike(r"clip:rect\(|clip-path:inset\(|overflow:hidden")
    surely = (attr("aria-hidden") == "true") | F.arrays_overlap(classes, F.array(*map(F.lit, HIDDEN_CLASSES))) | clipped
    maybe = (F.lower(attr("hidden")) != "until-found") | style.rlike("display:none|visibility:hidden")
    # What an element holds is the sums at a mark behind its last node less those at itself.
    marked = nodes.withColumns({"_surely": F.coalesce(surely, F.lit(False)), "_maybe": F.coalesce(maybe, F.lit(False))})
    marked = marked.withColumn("_mark", F.explode(F.when(F.col("_maybe") & ~F.col("_surely"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    to_here = Window.partitionBy("doc").orderBy(F.when(F.col("_mark") == 1, F.col("last")).otherwise(F.col("id")), "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = lambda condition: F.coalesce(F.sum((condition & (F.col("_mark") == 0)).cast("int")).over(to_here), F.lit(0))
    marked = marked.withColumns({"_sections": counted(F.col("name").isin("h1", "h2", "h3", "h4", "h5", "h6", "table")), "_paragraphs": counted(F.col("name") == "p")})
    behind = lambda c: F.max(F.when(F.col("_mark") == 1, F.col(c))).over(Window.partitionBy("doc", "id"))
    held = marked.withColumns({"_sections_to": behind("_sections"), "_paragraphs_to": behind("_paragraphs")}).where("_mark = 0")
    empty = F.expr("coalesce(name, '') <> 'table' and _sections_to = _sections and _paragraphs_to - _paragraphs < 2")
    return without(held, F.col("_surely") | F.coalesce(empty, F.lit(False))).select(nodes.columns)


def resolvable_pictures(nodes: DataFrame) -> DataFrame:
    """nodes whose pictures can be shown without the page's own site: others lose their source, or go if the link or button
    around them says what their alternate text says."""
    blind = (F.col("name") == "img") & ~F.coalesce(attr("src"), F.lit("")).rlike(r"(?i)^\s*(?:data|https?):")
    alt = F.trim(F.coalesce(attr("alt"), F.lit("")))
    # A control in none is followed by what it holds before the next of its kind, so the last one up to here is the outermost around a node that it holds.
    is_control = F.col("name").isin("a", "button")
    latest = F.max(F.when(is_control & F.col("control").isNull(), F.struct("id", "last"))).over(_to_here())
    placed = nodes.withColumn("_latest", latest).withColumn("_top", F.when(F.col("control").isNotNull() & (F.col("_latest.last") >= F.col("id")), F.col("_latest.id")))
    # Texts of an outermost control, and the controls in it, in order; nodes outside of controls have none.
    around = Window.partitionBy("doc", "_top").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = F.struct("id", "last", "text")
    held = F.collect_list(F.when(F.col("_top").isNotNull() & (F.col("name").isNull() | is_control), part)).over(around)

    def said(held: Column) -> Column:
        """What the innermost control around a picture says, in lower case."""
        last = F.try_element_at(F.filter(held, lambda e: e["id"] == F.col("control")), F.lit(1))["last"]
        texts = F.when(F.col("control") == F.col("_top"), held).otherwise(F.filter(held, lambda e: (e["id"] > F.col("control")) & (e["id"] <= last)))
        return F.lower(F.trim(F.regexp_replace(F.array_join(F.transform(texts, lambda e: e["text"]), ""), r"\s+", " ")))

    asked = blind & (alt != "") & F.col("_top").isNotNull()
    marked = placed.withColumn("_held", held).where(~F.coalesce(F.when(asked, F.contains(said(F.col("_held")), F.lower(alt))), F.lit(False)))
    return marked.withColumn("attrs", F.when(blind, without_attrs("src")).otherwise(F.col("attrs"))).select(nodes.columns)


def without_remote_pictures(nodes: DataFrame) -> DataFrame:
    """nodes with a line in place of every picture that stands on another machine: its alternate text, or that there was one."""
    remote = (F.col("name") == "img") & F.coalesce(url.is_remote_picture(attr("src")), F.lit(False))
    alt = F.coalesce(attr("alt"), F.lit(""))
    line = F.concat(F.lit("<p><em>[image: "), F.when(alt == "", "not included").otherwise(text.escape_text(alt)), F.lit("]</em></p>"))
    return nodes.withColumn("raw", F.when(remote, line).otherwise(F.col("raw") if "raw" in nodes.columns else F.lit(None).cast("string")))


def absolute_links(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """nodes whose links are resolved against their page's address; bases: (doc, base). Fragments stay, an address that cannot be resolved goes."""
    href = attr("href")
    link = (F.col("name") == "a") & href.isNotNull() & ~F.startswith(F.coalesce(href, F.lit("")), F.lit("#"))
    joined = nodes.join(bases.select("doc", "base"), "doc", "left")
    return joined.withColumn("attrs", F.when(link, with_attr("href", url.resolved(href, F.col("base")))).otherwise(F.col("attrs"))).select(nodes.columns)


def without_dead_links(nodes: DataFrame) -> DataFrame:
    """nodes in which a link without an address is its content only."""
    return unwrapped(nodes, (F.col("name") == "a") & ~F.map_contains_key("attrs", "href"))


def drawn_blocks(nodes: DataFrame) -> DataFrame:
    """nodes in which code that is drawn, a diagram or a formula, has the one name of its language and its block has no class."""
    language = F.try_element_at(F.create_map(*[F.lit(x) for pair in DRAWN.items() for x in pair]), F.lower(F.regexp_extract(attr("class"), r"^language-([\w+-]+)$", 1)))
    order = Window.partitionBy("doc").orderBy("id")
    drawn = F.when((F.col("name") == "code") & (F.lag("name").over(order) == "pre") & (F.lag("id").over(order) == F.col("parent")), language)
    marked = nodes.withColumn("_drawn", drawn)
    marked = marked.withColumn("_holds", (F.col("name") == "pre") & (F.lead("parent").over(order) == F.col("id")) & F.lead("_drawn").over(order).isNotNull())
    attrs = F.when(F.col("_drawn").isNotNull(), with_attr("class", F.concat(F.lit("language-"), F.col("_drawn")))).when(F.col("_holds"), without_attrs("class")).otherwise(F.col("attrs"))
    return marked.withColumn("attrs", attrs).select(nodes.columns)


def unwrapped(nodes: DataFrame, condition: Column) -> DataFrame:
    """nodes without the tags, but with the content, of elements that meet a condition."""
    return nodes.where(~F.coalesce(condition, F.lit(False)))


def _plain_url(value: Column) -> Column:
    """An address as far as its scheme goes: without the white space, controls and comments that hide one."""
    return F.regexp_replace(F.regexp_replace(value, r"[\x00-\x20]+", ""), r"<!--.*?-->", "")


def _allowed(value: Column, schemes: list[str]) -> Column:
    scheme = F.lower(F.regexp_extract(_plain_url(value), r"^([a-zA-Z][a-zA-Z0-9.\-+]*):", 1))
    return (scheme == "") | scheme.isin(*schemes)


def allowed(nodes: DataFrame) -> DataFrame:
    """nodes of the elements, attributes and addresses that a document keeps; other tags go but not their content, save that of scripts and the like.

    Labels of notes, colours of marks, alignments of cells and languages of code are kept in the one form that means them. A
    picture without a source is its alternate text in brackets, or nothing.
    """
    kept = without(nodes, F.col("name").isin(*SILENT))
    kept = kept.where(F.col("name").isNull() | F.col("name").isin(*KEPT))
    names = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in ATTRIBUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("name")), F.array().cast("array<string>"))
    right = {
        "href": F.when(_allowed(attr("href"), SCHEMES), attr("href")),
        "src": F.when(_allowed(attr("src"), PICTURE_SCHEMES), attr("src")),
        "data-fn": F.when(attr("data-fn").rlike(text.NOTE_LABEL), attr("data-fn")),
        "class": F.when(F.col("name") == "code", text.code_class(attr("class"))).otherwise(attr("class")),
        "style": F.when(F.col("name") == "mark", text.mark_style(attr("style"))).otherwise(text.cell_style(attr("style"), attr("align"))),
    }
    entries = F.map_entries(F.map_filter("attrs", lambda k, v: F.array_contains(names, k) & ~k.isin(*right)))
    made = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.when(F.array_contains(names, k), v).alias("value")) for k, v in right.items()]), lambda e: e["value"].isNotNull())
    order = F.array(*[F.lit(a) for a in ("href", "src", "title", "alt", "width", "height", "colspan", "rowspan", "class", "style", "data-fn")])
    # The entries are worked out once and then picked in order.
    in_order = F.transform(F.array(F.concat(entries, made)), lambda es: F.flatten(F.transform(order, lambda k: F.filter(es, lambda e: e["key"] == k))))
    sorted_entries = in_order[0]
    attrs = F.when(F.col("name").isNotNull() & (F.size("attrs") > 0), F.map_from_entries(sorted_entries)).otherwise(F.col("attrs"))
    # Pictures are judged by the attributes as given: a condition on the new ones would be moved before them, and work them out again.
    blind = (F.col("name") == "img") & right["src"].isNull()
    alt = F.trim(F.coalesce(attr("alt"), F.lit("")))
    kept = kept.where(~F.coalesce(blind & (alt == ""), F.lit(False)))
    return drawn_blocks(kept.withColumns({"attrs": attrs, "raw": F.when(blind, F.concat(F.lit("<span>["), text.escape_text(alt), F.lit("]</span>")))}))


def written(nodes: DataFrame, all_docs: DataFrame | None = None) -> DataFrame:
    """(doc, html) of nodes in order. all_docs (doc) adds the documents that have no node left, with empty html."""
    raw = F.col("raw") if "raw" in nodes.columns else F.lit(None).cast("string")
    pairs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), text.escape_html(e["value"]), F.lit('"'))), "")
    alone = F.col("name").isin(*WRITTEN_ALONE)
    plain = F.when(F.coalesce(F.map_contains_key("attrs", "raw"), F.lit(False)), F.col("text")).otherwise(text.escape_text(F.col("text")))
    begin = F.when(raw.isNotNull(), raw).when(F.col("name").isNull(), plain).otherwise(F.concat(F.lit("<"), "name", pairs, F.when(alone, " />").otherwise(">")))
    start = F.struct(F.col("id").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("inner"), begin.alias("html"))
    end = F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("id")).alias("inner"), F.concat(F.lit("</"), "name", F.lit(">")).alias("html"))
    has_end = F.col("name").isNotNull() & ~F.coalesce(alone, F.lit(False)) & raw.isNull()
    tags = nodes.where("id is not null").select("doc", F.explode(F.when(has_end, F.array(start, end)).otherwise(F.array(start))).alias("tag"))
    html = tags.groupBy("doc").agg(text.strip_xml_illegal(F.array_join(F.array_sort(F.collect_list("tag"))["html"], "")).alias("html"))
    return html if all_docs is None else all_docs.select("doc").join(html, "doc", "left").select("doc", F.coalesce("html", F.lit("")).alias("html"))
