"""Ordered computations over a document's parts: runs, gaps, sections, edges, names and notes, as windows and joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quire.functions.text import github_slug
from quire.operators.ranges import dealt
from quire.operators.stored import stored


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with `run`: a number for each stretch of equal values, nulls equal to each other."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return df.withColumn("new", new).withColumn("run", F.sum("new").over(w)).drop("new")


def gaps(df: DataFrame, keys: list[str], order: list[str], start: Column, end: Column, pause: float) -> DataFrame:
    """df with `part`: a new one where a start is at least `pause` after the end before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("new", F.when(start - F.lag(end).over(w) >= pause, 1).otherwise(0))
    return marked.withColumn("part", F.sum("new").over(w)).drop("new")


def sections(df: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """df with `section`: 0 before the first start, then counted by starts."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("section", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def joined_text(df: DataFrame, keys: list[str], order: str, text: str, by: str = " ") -> DataFrame:
    """One row a group: its texts in order, the first order value and their number."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), by).alias("text"), F.min(order).alias("first"), F.count("*").alias("n"))


def slides(blocks: DataFrame) -> DataFrame:
    """blocks (doc, pos, tag, text) with the slide each is on; rules and empty slides give none.

    A document with a rule is cut at its rules; else at h2 if it has at most one h1 and two h2; else at h1.
    """
    per = Window.partitionBy("doc")
    count = lambda tag: F.sum((F.col("tag") == tag).cast("int")).over(per)
    rule = F.when(count("hr") > 0, "hr").when((count("h1") <= 1) & (count("h2") >= 2), "h2").otherwise("h1")
    cut = sections(blocks.withColumn("rule", rule), ["doc"], "pos", F.col("tag") == F.col("rule")).where("not (rule = 'hr' and tag = 'hr')")
    return cut.withColumn("slide", F.dense_rank().over(Window.partitionBy("doc").orderBy("section"))).drop("section")


def chapters(blocks: DataFrame) -> DataFrame:
    """blocks with their chapter and its title: cut at h1 if there are two, else at h2 if two, else at the one h1; before it, "Start"."""
    per = Window.partitionBy("doc")
    count = lambda tag: F.sum((F.col("tag") == tag).cast("int")).over(per)
    level = F.when(count("h1") >= 2, "h1").when(count("h2") >= 2, "h2").when(count("h1") == 1, "h1").otherwise("")
    cut = sections(blocks.withColumn("level", level), ["doc"], "pos", F.col("tag") == F.col("level"))
    numbered = cut.withColumn("chapter", F.dense_rank().over(Window.partitionBy("doc").orderBy("section")))
    of = Window.partitionBy("doc", "chapter").orderBy("pos")
    heading = F.first(F.when(F.col("tag") == F.col("level"), F.trim("text"))).over(of)
    return numbered.withColumn("title", F.when(F.col("section") == 0, "Start").when(heading != "", heading).otherwise(F.concat(F.lit("Chapter "), F.col("chapter").cast("string")))).drop("section", "level")


def running_heads(lines: DataFrame) -> DataFrame:
    """lines (doc, page, n, text) without the heads and feet that most of a document's pages repeat.

    Of each page the first and last two lines count, digits alike; on a document of four pages or more, lines at an edge go
    while their text counts for more than half of the pages. A short page's line may count twice.
    """
    page = Window.partitionBy("doc", "page")
    up, down = page.orderBy("n"), page.orderBy(F.col("n").desc())
    key = F.trim(F.regexp_replace("text", "[0-9]+", "#"))
    at = lines.withColumns({"key": key, "from_top": F.row_number().over(up), "from_end": F.row_number().over(down), "size": F.count("*").over(page)})
    times = F.when(F.col("from_top") <= 2, 1).otherwise(0) + F.when(F.col("from_end") <= 2, 1).otherwise(0)
    counts = at.where("from_top <= 2 or from_end <= 2").groupBy("doc", "key").agg(F.sum(times).alias("hits"))
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    repeated = counts.join(pages, "doc").where("pages >= 4 and hits > pages / 2").select("doc", "key", F.lit(True).alias("repeated"))
    flagged = at.join(repeated, ["doc", "key"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    edge = lambda w: F.min(F.col("repeated").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return flagged.withColumns({"head": edge(up), "foot": edge(down)}).where("not head and not foot").select(*lines.columns)


def heading_anchors(headings: DataFrame) -> DataFrame:
    """headings (doc, pos, text) with `anchor`: the slug, numbered where it repeats within a document."""
    slug = github_slug(F.col("text"))
    nth = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("pos")) - 1
    return headings.withColumn("slug", slug).withColumn("anchor", F.when(nth > 0, F.concat("slug", F.lit("-"), nth.cast("string"))).otherwise(F.col("slug"))).drop("slug")


def resolve_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (doc, pos, target) with the heading they lead to: the anchor as written, else in lower case; null: unwrapped."""
    named = anchors.select(F.col("doc").alias("h_doc"), "anchor", F.col("pos").alias("heading_pos"))
    exact = links.join(named, (F.col("doc") == F.col("h_doc")) & (F.col("target") == F.col("anchor")), "left").drop("h_doc", "anchor")
    lower = named.select(F.col("h_doc"), F.col("anchor").alias("low"), F.col("heading_pos").alias("low_pos"))
    both = exact.join(lower, (F.col("doc") == F.col("h_doc")) & (F.lower("target") == F.col("low")), "left")
    return both.select(*links.columns, F.coalesce("heading_pos", "low_pos").alias("heading_pos"))


def footnotes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, label, number, n_refs, has_note): notes numbered by their first reference, unreferenced ones after them; references without a note follow all notes. Labels that tie in all that stand in their order."""
    first = refs.groupBy("doc", "label").agg(F.min("pos").alias("first_ref"), F.count("*").alias("n_refs"))
    own = notes.groupBy("doc", "label").agg(F.min("pos").alias("note_pos"))
    both = own.join(first, ["doc", "label"], "full_outer")
    order = Window.partitionBy("doc").orderBy(F.col("note_pos").isNull(), F.col("first_ref").asc_nulls_last(), "note_pos", "label")
    return both.select("doc", "label", F.row_number().over(order).alias("number"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.col("note_pos").isNotNull().alias("has_note"))


def unique_names(names: DataFrame, keys: list[str], order: str, name: str = "name") -> DataFrame:
    """names with `unique_name`: the n-th of a name, by case-insensitive comparison, gets "-n" before its extension.

    A made name that is also given, or made twice, gets another number behind it: the first of 2, 3, ... that gives no name that is
    given or made. Given names stay as they are. (keys, order) names a row. Each window gets its rows dealt over many tasks, so that
    a task sorts few of them.
    """
    cut = lambda of: (F.regexp_replace(of, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(of, r"(?<=.)(\.[^.]*)$", 1))
    nth = F.row_number().over(Window.partitionBy(*keys, F.lower(name)).orderBy(order))
    stem, ext = cut(F.col(name))
    made = dealt(names, *keys, F.lower(name)).withColumn("nth", nth).withColumn("made", F.when(F.col("nth") > 1, F.concat(stem, F.lit("-"), F.col("nth").cast("string"), ext)).otherwise(F.col(name)))
    again = F.row_number().over(Window.partitionBy(*keys, F.lower("made")).orderBy(F.col("nth") > 1, order))
    stem, ext = cut(F.col("made"))
    tried = stored(dealt(made, *keys, F.lower("made")).withColumns({"again": again - 1, "stem": stem, "ext": ext}))  # read three times
    # Numbers in use behind a stem: the j-th of them, t, leaves t - 1 - j free ones from 2 below it, so the k-th free one is k + 1 and one for each t - j up to k.
    used = tried.select(*keys, F.lower("stem").alias("used"), F.lower("ext").alias("low_ext"))
    used = used.select(*keys, F.regexp_extract("used", r"^(.+)-[1-9][0-9]*$", 1).alias("low_stem"), "low_ext", F.regexp_extract("used", r"-([1-9][0-9]{0,17})$", 1).try_cast("long").alias("t")).where("t > 1 and low_stem <> ''").distinct()
    of_stem = Window.partitionBy(*keys, "low_stem", "low_ext")
    left = used.withColumn("at", F.col("t") - F.row_number().over(of_stem.orderBy("t"))).drop("t").withColumn("is_used", F.lit(1))
    late = tried.where("again > 0").withColumns({"low_stem": F.lower("stem"), "low_ext": F.lower("ext"), "at": F.col("again").cast("long"), "is_used": F.lit(0)})
    counted = dealt(late.unionByName(left, allowMissingColumns=True), *keys, "low_stem", "low_ext").withColumn("passed", F.sum("is_used").over(of_stem.orderBy("at", F.desc("is_used")).rowsBetween(Window.unboundedPreceding, 0))).where("is_used = 0")
    renamed = counted.withColumn("unique_name", F.concat("stem", F.lit("-"), (F.col("again") + 1 + F.col("passed")).cast("string"), "ext"))
    kept = tried.where("again = 0").withColumn("unique_name", F.col("made"))
    return kept.select(*names.columns, "unique_name").unionByName(renamed.select(*names.columns, "unique_name"))


def merged(parts: DataFrame) -> DataFrame:
    """(group, html, title): documents (group, ord, title, html) in order, each under its title, with page breaks between; the title is the first's."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "html"))), lambda x: F.concat(F.lit("<h1>"), x["title"], F.lit("</h1>"), x["html"]))
    return parts.groupBy("group").agg(F.array_join(each, '<div class="page-break"></div>').alias("html"), F.min_by("title", "ord").alias("title"))


def prefixed_labels(labels: DataFrame) -> DataFrame:
    """labels (group, ord, label) with `unique_label`: a label that an earlier document of the group has gets the prefix s{ord}."""
    seen = F.min("ord").over(Window.partitionBy("group", "label")) < F.col("ord")
    return labels.withColumn("unique_label", F.when(seen, F.concat(F.lit("s"), F.col("ord").cast("string"), F.lit("."), "label")).otherwise(F.col("label")))


def spine(manifest: DataFrame, order: DataFrame) -> DataFrame:
    """order (doc, spine_pos, item) with the manifest's href, or missing."""
    return order.join(manifest, ["doc", "item"], "left").select("doc", "spine_pos", "item", "href", F.col("href").isNull().alias("missing"))


def allowed_targets(inputs: DataFrame, targets: dict[str, tuple[str, ...]], every: tuple[str, ...]) -> DataFrame:
    """(group, targets): output formats that all inputs (group, format) of a group allow, in their fixed order."""
    by_format = F.array(*(F.lit(t) for t in every))
    for name, own in targets.items():
        by_format = F.when(F.col("format") == name, F.array(*(F.lit(t) for t in own))).otherwise(by_format)
    each = inputs.select("group", "format").distinct().select("group", "format", F.explode(by_format).alias("target")).groupBy("group", "target").agg(F.count("*").alias("n"))
    total = inputs.groupBy("group").agg(F.countDistinct("format").alias("formats"))
    both = each.join(total, "group").where("n = formats").groupBy("group").agg(F.collect_set("target").alias("found"))
    return total.select("group").join(both, "group", "left").select("group", F.filter(F.array(*(F.lit(t) for t in every)), lambda t: F.coalesce(F.array_contains("found", t), F.lit(False))).alias("targets"))


def cross_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (doc, pos, file, href) with `resolved`: a link to an anchor (doc, pos, anchor, file) that stands in another file gets that file's name before it; of equal anchors the last counts."""
    last = anchors.groupBy("doc", "anchor").agg(F.max_by("file", "pos").alias("to"))
    local = links.withColumn("anchor", F.when(F.col("href").startswith("#"), F.substring("href", 2, 2**31 - 1)))
    both = local.join(last, ["doc", "anchor"], "left")
    return both.select(*links.columns, F.when(F.col("to").isNotNull() & (F.col("to") != F.col("file")), F.concat("to", "href")).otherwise(F.col("href")).alias("resolved"))


def positional(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The n-th row of left with the n-th of right within the keys; keys whose sides differ in number have no rows, as nothing can tell which is missing."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    numbered = [side.withColumn("n", nth) for side in (left, right)]
    counts = [side.groupBy(*keys).agg(F.count("*").alias(f"count_{k}")) for k, side in enumerate((left, right))]
    even = counts[0].join(counts[1], keys).where("count_0 = count_1").select(*keys)
    others = [c for c in right.columns if c not in keys]
    return numbered[0].join(even, keys, "left_semi").join(numbered[1].select(*keys, "n", *(F.col(c).alias(f"right_{c}") for c in others)), [*keys, "n"])


def paragraphs(lines: DataFrame) -> DataFrame:
    """lines (doc, page, n, text, y) with `block`: a new one where the gap above a line is over one and a half times the page's median gap."""
    page = Window.partitionBy("doc", "page").orderBy("n")
    gap = lines.withColumn("gap", F.abs(F.lag("y").over(page) - F.col("y")))
    positive = gap.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("gaps"))
    normal = positive.select("doc", "page", F.coalesce(F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")), F.lit(0.0)).alias("normal"))
    marked = gap.join(normal, ["doc", "page"]).withColumn("new", ((F.col("normal") > 0) & (F.col("gap") > 1.5 * F.col("normal"))).cast("int"))
    return marked.withColumn("block", F.sum(F.coalesce("new", F.lit(0))).over(page)).select(*lines.columns, "block")


def joined_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One text a group of lines (n, text): a line that ends in a hyphen at a word goes on without a space."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.concat(x["text"], F.when(x["text"].rlike(r"[\p{L}\p{N}]-$"), "").otherwise(" ")))
    return lines.groupBy(*keys).agg(F.array_join(parts, "").alias("text"), F.count("*").alias("n_lines")).withColumn("text", F.regexp_replace("text", " $", ""))


def rebased_levels(items: DataFrame) -> DataFrame:
    """items (doc, level, ...) with `depth` from 0: the levels that a document uses, without gaps."""
    used = items.select("doc", "level").distinct()
    depth = used.withColumn("depth", F.dense_rank().over(Window.partitionBy("doc").orderBy("level")) - 1)
    return items.join(depth, ["doc", "level"]).select(*items.columns, "depth")


def rejoined_lists(items: DataFrame) -> DataFrame:
    """Ordered items (doc, pos, num_id) with `number`: lists of one numbering go on where other blocks interrupted them."""
    return items.withColumn("number", F.row_number().over(Window.partitionBy("doc", "num_id").orderBy("pos")))


def best_of(scored: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """(keys, best, score, ratio): the name with the highest score, the first by name on a tie, and the runner-up's share of it."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)
    two = scored.withColumn("place", F.row_number().over(order)).where("place <= 2")
    top = two.groupBy(*keys).agg(F.max(F.when(F.col("place") == 1, F.col(name))).alias("best"), F.max(F.when(F.col("place") == 1, F.col(score))).alias("score"), F.max(F.when(F.col("place") == 2, F.col(score))).alias("second"))
    return top.select(*keys, "best", "score", (F.coalesce("second", F.lit(0)) / F.col("score")).alias("ratio"))


def distinct_notices(notices: DataFrame) -> DataFrame:
    """(doc, messages): each message once, in the order in which it came first."""
    first = notices.groupBy("doc", "message").agg(F.min("pos").alias("pos"))
    return first.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"]).alias("messages"))


def nth_part(parts: DataFrame, n: int) -> DataFrame:
    """The n-th part (from 1, by `pos`) of each document; a document with fewer has a row with an error."""
    numbered = parts.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    total = numbered.groupBy("doc").agg(F.count("*").alias("total"))
    chosen = total.join(numbered.where(F.col("n") == n).drop("n"), "doc", "left")
    return chosen.withColumn("error", F.when(F.col("total") < n, F.concat(F.lit(f"there is no part {n}, only "), F.col("total").cast("string")))).drop("total")


def reading_order(items: DataFrame) -> DataFrame:
    """items (doc, page, x0, y, ...) with `place`: from the top of a page down, and from left to right."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.col("y").desc(), "x0")))


def embedded_parts(pictures: DataFrame, parts: DataFrame) -> DataFrame:
    """pictures (doc, pos, cid) with the part that each names: of parts (doc, part, cid) the first with the same identifier, else the first that differs in case only."""
    same = parts.groupBy("doc", "cid").agg(F.min("part").alias("same"))
    alike = parts.groupBy("doc", F.lower("cid").alias("low")).agg(F.min("part").alias("alike"))
    found = pictures.withColumn("low", F.lower("cid")).join(same, ["doc", "cid"], "left").join(alike, ["doc", "low"], "left")
    return found.select("doc", "pos", "cid", F.coalesce("same", "alike").alias("part"))


def admitted(pictures: DataFrame, least: int = 10 << 20, factor: int = 2, overhead: int = 64) -> DataFrame:
    """pictures (doc, pos, size, file_size) with `admitted`: in order, each that still fits the document's budget, max(least, factor * file_size), at its size and `overhead`.

    One that does not fit is passed over and later ones are still tried, so no running sum tells it; rows stream in order
    with one sum a document in memory.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, spent = None, 0
        for batch in batches:
            out = []
            for d, size, file_size in zip(*(batch.column(n).to_pylist() for n in ("doc", "size", "file_size")), strict=True):
                if d != doc:
                    doc, spent = d, 0
                fits = spent + size + overhead <= max(least, factor * file_size)
                spent += (size + overhead) * fits
                out.append(fits)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc", "pos", "size", "file_size")), pa.array(out, pa.bool_())], names=["doc", "pos", "size", "file_size", "admitted"])

    rows = pictures.select("doc", "pos", F.col("size").cast("long").alias("size"), F.col("file_size").cast("long").alias("file_size"))
    return rows.repartition("doc").sortWithinPartitions("doc", "pos").mapInArrow(judged, StructType([*rows.schema.fields, StructField("admitted", BooleanType())]))


def note_marks(refs: DataFrame, style: str) -> DataFrame:
    """refs (doc, pos, label, number) with the html of each mark in the text, in the style links, epub, plain or text; of a label's marks the first is what its note leads back to."""
    number, label = F.col("number").cast("string"), F.col("label")
    if style == "text":
        return refs.withColumn("html", F.concat(F.lit("["), number, F.lit("]")))
    if style == "plain":
        return refs.withColumn("html", F.concat(F.lit("<sup>"), number, F.lit("</sup>")))
    first = F.row_number().over(Window.partitionBy("doc", "label").orderBy("pos")) == 1
    start, kind = ("<sup>", ' epub:type="noteref"') if style == "epub" else ('<sup class="fnref">', "")
    target = F.when(first, F.concat(F.lit(' id="fnref-'), label, F.lit('"'))).otherwise("")
    return refs.withColumn("html", F.concat(F.lit(f'{start}<a{kind} href="#fn-'), label, F.lit('"'), target, F.lit(">"), number, F.lit("</a></sup>")))


def note_items(notes: DataFrame, refs: DataFrame, style: str) -> DataFrame:
    """notes (doc, label, body) with the html of each as a list item; in the linked styles a note that a mark names leads back, inside its last paragraph."""
    if style in ("text", "plain"):
        return notes.withColumn("html", F.concat(F.lit("<li>"), "body", F.lit("</li>")))
    back = F.concat(F.lit(' <a href="#fnref-'), "label", F.lit('" class="fnback" aria-label="Back to the text">↩</a>'))
    closed = F.regexp_replace("body", r"</p>\s*$", "")
    body = F.when(F.col("named").isNull(), F.col("body")).when(F.col("body").rlike(r"</p>\s*$"), F.concat(closed, back, F.lit("</p>"))).otherwise(F.concat("body", back))
    kind = ' epub:type="footnote"' if style == "epub" else ""
    named = notes.join(refs.select("doc", "label").distinct().withColumn("named", F.lit(True)), ["doc", "label"], "left")
    return named.withColumn("html", F.concat(F.lit('<li id="fn-'), "label", F.lit(f'"{kind}>'), body, F.lit("</li>"))).drop("named")


def numbered_parts(parts: DataFrame, keys: list[str], name: str = "part", to: str = "number") -> DataFrame:
    """parts with their place in the order of the number that ends their names before the extension, whatever the names' own order."""
    last = F.regexp_extract(name, r"([0-9]{1,18})\.[^.]*$", 1).try_cast("long")
    return parts.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(last, name)))


def distinct_pictures(pictures: DataFrame, doc: str, pos: str, digest: str) -> DataFrame:
    """(doc, digest, name): the pictures of a document that differ, each once, named img001, img002, ... in the order in which they are first seen."""
    first = pictures.groupBy(doc, digest).agg(F.min(pos).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(doc).orderBy("_first", digest)).cast("string")
    return first.select(doc, digest, F.concat(F.lit("img"), F.lpad(nth, F.greatest(F.length(nth), F.lit(3)), F.lit("0"))).alias("name"))
