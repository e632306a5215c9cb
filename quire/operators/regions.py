"""Tables on pages of positioned text: items to lines, lines to segments, runs of lines to regions, regions to grids.

Everything is an ordered relation: a line is an island between line ends, a segment one between wide gaps, a region one of
tabular lines and of the wrapped lines between them. The columns that a region's first grid shows are voted on by all its
lines, and then cut its items again, as what stands close together may be two cells; that can add columns to a table, never
make one. A region with a column of list markers is a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.geometry import GridRules, column_origins, infer_cells
from quire.operators.stored import stored

#: The gap between cells in line heights, how far items of a column stand apart, what makes a region a table, and the share of markers that makes a column a list's.
CELL_GAP, TOLERANCE, MOST_MARKERS = 0.9, 3.5, 0.6
#: Fixed value: what is a bullet or the number of a list's item.
LIST_MARKER = r"^(?:[^\p{L}\p{N}]{1,2}|[oO]|\d{1,2}[.)]|[A-Za-z][.)])$"
RULES = GridRules(min_rows=3, min_columns=2, tolerance=TOLERANCE, min_confidence=0.75)
_PIECE = "array<struct<text:string,x0:double,x1:double,space:boolean>>"


def _lined(items: DataFrame) -> DataFrame:
    """items with line: one ends with an item that says so."""
    order = Window.partitionBy("doc", "page").orderBy("n")
    return items.withColumn("line", F.coalesce(F.sum(F.col("eol").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _spaced(lined: DataFrame) -> DataFrame:
    drawn = lined.where("text <> ''")
    # The order is that of the lines: the item before is of this line or of an earlier one.
    order = Window.partitionBy("doc", "page").orderBy("n")
    before = F.when(F.lag("line").over(order) == F.col("line"), F.lag("text").over(order))
    space = F.col("text").rlike(r"^\s") | F.coalesce(before.rlike(r"\s$"), F.lit(False))
    return drawn.withColumn("space", space).where(F.col("text").rlike(r"\S"))


def _gapped(lined: DataFrame) -> DataFrame:
    """_lined() items of the pages that may have a line of two segments, in the order that the items are in already.

    A gap that parts a line parts two items of it that follow each other, in one direction or the other; so a page without such two has no region."""
    order = Window.partitionBy("doc", "page").orderBy("n")
    shown = F.col("text").rlike(r"\S")
    before = F.last(F.when(shown, F.struct("line", "x0", "x1", "height")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    least = CELL_GAP * F.greatest(F.col("height"), F.col("_before.height"), F.lit(1.0))
    apart = (F.col("x0") - F.col("_before.x1") > least) | (F.col("_before.x0") - F.col("x1") > least)
    wide = shown & (F.col("_before.line") == F.col("line")) & F.coalesce(apart, F.lit(True))
    marked = lined.withColumn("_before", before).withColumn("_wide", F.max(wide).over(Window.partitionBy("doc", "page")))
    return marked.where("_wide").select(lined.columns)


def positioned(items: DataFrame) -> DataFrame:
    """items (doc, page, n, text, x0, x1, y, height, eol) that hold text, with line and space (whether the page draws white space before one).

    A line ends with an item that says so; a blank item, and white space at an item's end, is the space before the next."""
    return _spaced(_lined(items))


def lines(items: DataFrame) -> DataFrame:
    """(doc, page, line, text, y, height): the lines of items, each at the height of its first item."""
    order = Window.partitionBy("doc", "page").orderBy("n")
    ended = F.coalesce(F.sum(F.col("eol").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = items.withColumn("line", ended).groupBy("doc", "page", "line").agg(F.array_sort(F.collect_list(F.struct("n", "text")))["text"].alias("texts"))
    text = whole.select("doc", "page", "line", F.trim(F.regexp_replace(F.array_join("texts", ""), r"[ \t]+", " ")).alias("text")).where("text <> ''")
    place = positioned(items).groupBy("doc", "page", "line").agg(F.min_by("y", "n").alias("y"), F.max("height").alias("height"))
    return text.join(place, ["doc", "page", "line"])


def segments(items: DataFrame) -> DataFrame:
    """(doc, page, line, seg, text, x0, x1, y, height): runs of positioned() items of a line without a gap of CELL_GAP line heights.

    With a column origins (array<double>), an item that stands apart on an origin that its segment began before starts another."""
    return _joined(_numbered(items))


def _numbered(items: DataFrame) -> DataFrame:
    """items with piece, and with the segment of their line that they are in, seg, and part, their text with the space before it."""
    line = Window.partitionBy("doc", "page", "line")
    row = line.orderBy("x0", "n", "piece")
    given = items if "piece" in items.columns else items.withColumn("piece", F.lit(0))
    gaps = given.withColumns({"gap": F.col("x0") - F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1)), "tall": F.greatest(F.max("height").over(line), F.lit(1.0))})
    starts = F.col("gap").isNull() | (F.col("gap") > CELL_GAP * F.col("tall"))
    if "origins" in items.columns:
        gaps = gaps.withColumn("band", F.try_element_at(F.filter("origins", lambda b: F.abs(F.col("x0") - b) <= TOLERANCE), F.lit(1)))
        # The first item apart in the band of an origin finds its segment begun before it.
        first = F.row_number().over(Window.partitionBy("doc", "page", "line", "band", F.coalesce(F.col("gap") > 1, F.lit(False))).orderBy("x0", "n", "piece")) == 1
        begun = F.min("x0").over(line) < F.col("band") - TOLERANCE
        starts = starts | F.coalesce((F.col("gap") > 1) & F.col("band").isNotNull() & first & begun, F.lit(False))
    marked = gaps.withColumn("starts", starts).withColumn("seg", F.sum(F.col("starts").cast("int")).over(row))
    return marked.withColumn("part", F.concat(F.when(~F.col("starts") & ((F.col("gap") > 0.5) | F.col("space")), " ").otherwise(""), "text"))


def _joined(numbered: DataFrame) -> DataFrame:
    joined = numbered.groupBy("doc", "page", "line", "seg").agg(F.array_sort(F.collect_list(F.struct("x0", "n", "piece", "part")))["part"].alias("parts"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min_by("y", F.struct("x0", "n", "piece")).alias("y"), F.max("height").alias("height"))
    return joined.withColumn("text", F.trim(F.regexp_replace(F.array_join("parts", ""), r"\s+", " "))).drop("parts").where("text <> ''")


def _tabular_pages(numbered: DataFrame) -> DataFrame:
    """_numbered() items of pages on which some line has two segments; others have no region."""
    return numbered.withColumn("_most", F.max("seg").over(Window.partitionBy("doc", "page"))).where("_most >= 2").drop("_most")


def split_items(items: DataFrame) -> DataFrame:
    """Items cut at the origins that they run over, where a space lies close by the mean width of their characters; piece numbers what one item becomes.

    A cut snaps to its origin. The distance allowed is half a line height or three characters."""
    height = F.greatest(F.max("height").over(Window.partitionBy("doc", "page", "line")), F.lit(1.0))
    start = F.struct(F.array().cast(_PIECE).alias("done"), F.col("text").alias("text"), F.col("x0").alias("x0"), F.col("space").alias("space"))

    def cut(state, origin):
        text, x0 = state["text"], state["x0"]
        advance = (F.col("x1") - x0) / F.length(text)
        spaces = F.filter(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(text, k, F.lit(1)) == " ")
        best = F.array_min(F.transform(spaces, lambda k: F.struct(F.abs(x0 + advance * k - origin).alias("off"), k.alias("at"))))
        left, right = F.trim(F.substring(text, F.lit(1), best["at"] - 1)), F.trim(F.substring(text, best["at"] + 1, F.length(text)))
        here = (origin > x0 + TOLERANCE) & (origin < F.col("x1") - TOLERANCE) & (best["off"] <= F.greatest(F.col("tall") * 0.5, advance * 3)) & (left != "") & (right != "")
        piece = F.struct(left.alias("text"), x0.alias("x0"), (x0 + advance * (best["at"] - 1)).alias("x1"), state["space"].alias("space"))
        after = F.struct(F.array_append(state["done"], piece).alias("done"), right.alias("text"), origin.alias("x0"), F.lit(True).alias("space"))
        return F.when(F.coalesce(here, F.lit(False)), after).otherwise(state)

    spans = (F.col("x1") > F.col("x0")) & F.exists("origins", lambda b: (b > F.col("x0") + TOLERANCE) & (b < F.col("x1") - TOLERANCE))
    kept = F.array(F.struct("text", "x0", "x1", "space"))
    sized = items.withColumn("tall", height)
    folded = sized.withColumn("cut", F.when(spans, F.aggregate("origins", start, cut)))
    rest = F.array(F.struct(F.col("cut.text").alias("text"), F.col("cut.x0").alias("x0"), F.col("x1").alias("x1"), F.col("cut.space").alias("space")))
    pieces = folded.withColumn("pieces", F.when(F.col("cut").isNull(), kept).otherwise(F.concat(F.col("cut.done"), rest)))
    other = [c for c in items.columns if c not in ("text", "x0", "x1", "space")]
    return pieces.select(*other, F.posexplode("pieces").alias("piece", "p")).select(*other, "piece", "p.*")


def candidate_regions(segmented: DataFrame) -> DataFrame:
    """(doc, page, line, region): lines of two segments or more, with the runs of indented lines of one segment between and after them.

    A run belongs to the region before it if all its lines stand right of that region's left edge, and a tabular line or the page's end follows."""
    rows = segmented.groupBy("doc", "page", "line").agg(F.count("*").alias("segs"), F.min("x0").alias("left"))
    page = Window.partitionBy("doc", "page").orderBy("line")
    tabular = F.col("segs") >= 2
    turned = rows.withColumn("tabular", tabular).withColumn("turn", F.coalesce((F.lag("tabular").over(page) != F.col("tabular")).cast("int"), F.lit(1)))
    runs = turned.withColumn("run", F.sum("turn").over(page)).groupBy("doc", "page", "run").agg(F.first("tabular").alias("tabular"), F.min("left").alias("left"))
    listed = runs.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("run", "tabular", "left"))).alias("runs"))
    # The left edge is that of the runs of one region so far, so the runs of a page, a few, are folded in order.
    start = F.struct(F.array().cast("array<struct<run:bigint,region:int>>").alias("done"), F.lit(0).alias("region"), F.lit(None).cast("double").alias("edge"))

    def grow(s, run):
        joins = ~run["tabular"] & F.coalesce(run["left"] > s["edge"] + TOLERANCE, F.lit(False))
        opens = run["tabular"] & s["edge"].isNull()
        region = s["region"] + opens.cast("int")
        edge = F.when(run["tabular"], F.least(s["edge"], run["left"])).when(joins, s["edge"])
        done = F.when(run["tabular"] | joins, F.array_append(s["done"], F.struct(run["run"].cast("long").alias("run"), region.alias("region")))).otherwise(s["done"])
        return F.struct(done.alias("done"), region.alias("region"), edge.alias("edge"))

    grown = listed.select("doc", "page", F.explode(F.aggregate("runs", start, grow)["done"]).alias("r")).select("doc", "page", "r.*")
    return turned.withColumn("run", F.sum("turn").over(page)).join(grown, ["doc", "page", "run"]).select("doc", "page", "line", "region")


def tables(items: DataFrame) -> DataFrame:
    """(doc, page, region, r, c, value): the tables on the pages of items (doc, page, n, text, x0, x1, y, height, eol), y growing upwards."""
    # What follows is read several times, so it is made once, and prose is left out before its items are sorted again.
    placed = _spaced(_gapped(_lined(items)))
    numbered = stored(_tabular_pages(_numbered(placed)).select("doc", "page", "n", "line", "text", "x0", "x1", "y", "height", "space", "piece", "seg", "part"))
    once = stored(_joined(numbered))
    placed = numbered.drop("piece", "seg", "part")
    regions = candidate_regions(once)
    lines_of = stored(regions.withColumn("_lines", F.count("*").over(Window.partitionBy("doc", "page", "region"))).where(F.col("_lines") >= RULES.min_rows).drop("_lines"))
    key = F.to_json(F.struct(F.col("doc").alias("d"), F.col("page").alias("p"), F.col("region").alias("r")))
    flat = lambda segs: segs.select(key.alias("doc"), F.lit(0).alias("page"), "text", "x0", (-F.col("y")).alias("y"), "height")
    first_items = stored(flat(once.join(lines_of, ["doc", "page", "line"])))
    first = stored(infer_cells(first_items, RULES))
    good = first.select("doc").distinct()
    origins = column_origins(first_items.join(good, "doc", "left_semi"), TOLERANCE).select("doc", "origins")
    again_items = placed.join(lines_of, ["doc", "page", "line"]).withColumn("_key", key).join(origins.withColumnRenamed("doc", "_key"), "_key").drop("_key")
    again = segments(split_items(again_items)).join(lines_of, ["doc", "page", "line"])
    second = stored(infer_cells(stored(flat(again)), RULES))
    only_first = first.join(second.select("doc").distinct(), "doc", "left_anti")
    grid = second.unionByName(only_first)
    marks = grid.where("value <> ''").groupBy("doc", "c").agg(F.avg(F.col("value").rlike(LIST_MARKER).cast("int")).alias("share")).where(F.col("share") >= MOST_MARKERS)
    kept = grid.join(marks.select("doc").distinct(), "doc", "left_anti")
    at = F.from_json("doc", "d string, p int, r int")
    return kept.withColumn("at", at).select(F.col("at.d").alias("doc"), F.col("at.p").alias("page"), F.col("at.r").alias("region"), "r", "c", "value")
