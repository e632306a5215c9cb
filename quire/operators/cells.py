"""Tables in long form: one row a cell (doc, table_no, r, c, value); everything here is joins, groups and windows over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import is_numeric, json_string, json_value
from quire.functions.text import csv_cell, escape_html
from quire.operators.ranges import dealt, running

TABLE = ("doc", "table_no")
#: Pages in the order in which one is suggested, and the characters that fit across each.
SETUPS = (("Letter", False, 95), ("A4", True, 130), ("Letter", True, 123), ("Legal", True, 157), ("A3", False, 132), ("Tabloid", True, 198), ("A3", True, 186))


def unpivot(df: DataFrame, columns: list[str], *, doc: Column, order: list[str], header: bool = True, long: bool = False) -> DataFrame:
    """A relation as cells: rows numbered within a document by `order`, after a header row of the column names. long: documents that no task is to sort whole."""
    cells = F.array(*(F.struct(F.lit(i).alias("c"), F.coalesce(F.col(n).cast("string"), F.lit("")).alias("value")) for i, n in enumerate(columns)))
    named = df.withColumn("doc", doc.cast("string"))
    if long:
        numbered = running(named.withColumn("_one", F.lit(1).cast("long")), [F.col(c) for c in order], ["doc"], sums={"_nth": "_one"})
    else:
        numbered = named.withColumn("_nth", F.row_number().over(Window.partitionBy("doc").orderBy(*order)))
    body = numbered.withColumn("r", F.col("_nth").cast("int") - (0 if header else 1)).select("doc", F.lit(0).alias("table_no"), "r", F.explode(cells).alias("x")).select("doc", "table_no", "r", "x.c", "x.value")
    if not header:
        return body
    names = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(n).alias("value")) for i, n in enumerate(columns)))
    top = body.select("doc", "table_no").distinct().select("doc", "table_no", F.lit(0).alias("r"), F.explode(names).alias("x")).select("doc", "table_no", "r", "x.c", "x.value")
    return top.unionByName(body)


def rows_of(cells: DataFrame, value: Column | None = None) -> DataFrame:
    """(doc, table_no, r, cells): the values of each row in column order."""
    value = F.col("value") if value is None else value
    return cells.groupBy(*TABLE, "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", value.alias("v")))), lambda x: x["v"]).alias("cells"))


def trim_trailing(cells: DataFrame) -> DataFrame:
    """Without the empty rows and columns at the end; a table without any text stays as it is."""
    filled = F.trim("value") != ""
    last = cells.groupBy(*TABLE).agg(F.max(F.when(filled, F.col("r"))).alias("last_r"), F.max(F.when(filled, F.col("c"))).alias("last_c"))
    return cells.join(last, list(TABLE)).select(*cells.columns, "last_r", "last_c").where("last_r is null or (r <= last_r and c <= last_c)").drop("last_r", "last_c")


def with_content(cells: DataFrame) -> DataFrame:
    """Cells of tables in which some cell is not blank."""
    some = cells.groupBy(*TABLE).agg(F.bool_or(F.trim("value") != "").alias("some")).where("some").drop("some")
    return cells.join(some, list(TABLE), "left_semi")


def has_header(cells: DataFrame) -> DataFrame:
    """(doc, table_no, header): the first row has no number and some later one has."""
    number = is_numeric(F.col("value"))
    return cells.groupBy(*TABLE).agg((~F.bool_or((F.col("r") == 0) & number) & F.bool_or((F.col("r") > 0) & number)).alias("header"))


def modal_columns(cells: DataFrame) -> DataFrame:
    """(doc, table_no, n_rows, modal, tabular): the commonest number of cells in a row, the larger one on a tie; tabular if at least two columns in four fifths of two or more rows."""
    counts = cells.groupBy(*TABLE, "r").agg(F.count("*").alias("n")).groupBy(*TABLE, "n").agg(F.count("*").alias("hits"))
    best = counts.groupBy(*TABLE).agg(F.sum("hits").alias("n_rows"), F.max(F.struct("hits", "n")).alias("m"))
    return best.select(*TABLE, "n_rows", F.col("m.n").alias("modal"), ((F.col("n_rows") >= 2) & (F.col("m.n") >= 2) & (F.col("m.hits") * 5 >= F.col("n_rows") * 4)).alias("tabular"))


def marker_columns(cells: DataFrame, marker: str = r"^(?:[•◦▪‣*–-]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])$") -> DataFrame:
    """(doc, table_no, c, share): columns of which at least six tenths of the filled cells are list markers."""
    filled = cells.where(F.trim("value") != "")
    return filled.groupBy(*TABLE, "c").agg(F.avg(F.trim("value").rlike(marker).cast("double")).alias("share")).where("share >= 0.6")


def measures(cells: DataFrame) -> DataFrame:
    """(doc, table_no, needed, columns, text_chars): characters across that the longest words of the columns need (3 to 24 each, and 3 between), and text without white space."""
    longest = F.array_max(F.transform(F.split("value", r"\s+"), lambda w: F.length(w)))
    column = cells.groupBy(*TABLE, "c").agg(F.greatest(F.lit(3), F.least(F.lit(24), F.max(longest))).alias("w"), F.sum(F.length(F.regexp_replace("value", r"\s+", ""))).alias("t"))
    return column.groupBy(*TABLE).agg(F.sum(F.col("w") + 3).alias("needed"), F.count("*").alias("columns"), F.sum("t").alias("text_chars"))


def page_fit(measured: DataFrame, width: int = 95) -> DataFrame:
    """measured with fits (a page of `width` characters holds it) and the narrowest page that does, or the widest there is."""
    pages = sorted(SETUPS, key=lambda s: s[2])
    advice = F.lit(f"{max(SETUPS, key=lambda s: s[2])[0]} landscape")
    for size, landscape, chars in reversed(pages):
        advice = F.when(F.col("needed") <= chars, f"{size} {'landscape' if landscape else 'portrait'}").otherwise(advice)
    return measured.select("*", (F.col("needed") <= width).alias("fits"), F.when(F.col("needed") > width, advice).alias("suggestion"))


def csv_lines(cells: DataFrame) -> DataFrame:
    """(doc, table_no, r, line) by RFC 4180; to be written with CRLF line ends."""
    return rows_of(with_content(cells), csv_cell(F.col("value"))).select(*TABLE, "r", F.array_join("cells", ",").alias("line"))


def json_rows(cells: DataFrame) -> DataFrame:
    """(doc, table_no, r, row): objects by the header's names where there is a header with distinct names (blank: column1, ...), else arrays of all rows."""
    rows = rows_of(cells)
    top = rows.where("r = 0").select(*TABLE, F.col("cells").alias("names")).join(has_header(cells), list(TABLE))
    width = rows.groupBy(*TABLE).agg(F.max(F.size("cells")).alias("width"))
    named = top.join(width, list(TABLE)).withColumn("names", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.nullif(F.get("names", i), F.lit("")), F.concat(F.lit("column"), (i + 1).cast("string")))))
    keyed = named.withColumn("keyed", F.col("header") & (F.size(F.array_distinct("names")) == F.col("width"))).drop("header")
    joined = rows.join(keyed, list(TABLE))
    cell = lambda i: json_value(F.coalesce(F.get("cells", i), F.lit("")))
    places = F.sequence(F.lit(0), F.col("width") - 1)
    as_object = F.concat(F.lit("{"), F.array_join(F.transform(places, lambda i: F.concat(json_string(F.get("names", i)), F.lit(": "), cell(i))), ", "), F.lit("}"))
    as_array = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.size("cells") - 1), cell), ", "), F.lit("]"))
    return joined.where(~F.col("keyed") | (F.col("r") > 0)).select(*TABLE, "r", F.when(F.col("keyed"), as_object).otherwise(as_array).alias("row"))


def shared_alignments(cells: DataFrame) -> DataFrame:
    """(doc, table_no, c, align) from cells with `is_header` and `align` (null: none): what the filled body cells of a column agree in, or, where it has none, the first row's; null where they differ."""
    body = (F.col("r") > 0) & ~F.col("is_header") & (F.col("value") != "")
    of = F.coalesce("align", F.lit("none"))
    column = cells.groupBy(*TABLE, "c").agg(F.min(F.when(body, of)).alias("low"), F.max(F.when(body, of)).alias("high"), F.max(F.when(F.col("r") == 0, of)).alias("top"))
    shared = F.when(F.col("low").isNull(), F.col("top")).when(F.col("low") == F.col("high"), F.col("low"))
    return column.select(*TABLE, "c", F.nullif(shared, F.lit("none")).alias("align"))


#: The border of a column by its alignment.
BORDERS = {"left": ":---", "center": ":---:", "right": "---:"}


def pipe_rows(cells: DataFrame, aligns: DataFrame | None = None) -> DataFrame:
    """(doc, table_no, line_no, line) of Markdown tables: the first row, the border, the other rows; bars escaped, line ends as <br>, short rows filled up. aligns: shared_alignments()."""
    value = F.regexp_replace(F.replace(F.col("value"), F.lit("|"), F.lit("\\|")), r"\r\n?|\n", "<br>")
    width = cells.groupBy(*TABLE, "r").agg(F.count("*").alias("n")).groupBy(*TABLE).agg(F.max("n").cast("int").alias("width"))
    wide = rows_of(cells, value).join(width, list(TABLE))
    line = lambda each: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), each), " | "), F.lit(" |"))
    body = wide.select(*TABLE, F.when(F.col("r") == 0, 0).otherwise(F.col("r") + 1).alias("line_no"), line(lambda i: F.coalesce(F.get("cells", i), F.lit(""))).alias("line"))
    marks = F.create_map(*(F.lit(x) for pair in BORDERS.items() for x in pair))
    if aligns is None:
        named = width.withColumn("marks", F.expr("cast(map() as map<int,string>)"))
    else:
        each = aligns.where("align is not null").groupBy(*TABLE).agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), F.element_at(marks, F.col("align"))))).alias("marks"))
        named = width.join(each, list(TABLE), "left").withColumn("marks", F.coalesce("marks", F.expr("cast(map() as map<int,string>)")))
    border = named.select(*TABLE, F.lit(1).alias("line_no"), line(lambda i: F.coalesce(F.try_element_at("marks", i), F.lit("---"))).alias("line"))
    return body.unionByName(border)


def promoted_headers(cells: DataFrame, marked: DataFrame) -> DataFrame:
    """cells with `is_header` made true on the first row of tables that `marked` (doc, table_no) names and that have no header cell."""
    any_header = cells.groupBy(*TABLE).agg(F.bool_or("is_header").alias("any_header"))
    flagged = cells.join(any_header, list(TABLE)).join(marked.select(*TABLE, F.lit(True).alias("marked")).distinct(), list(TABLE), "left")
    return flagged.withColumn("is_header", F.col("is_header") | ((F.col("r") == 0) & F.coalesce("marked", F.lit(False)) & ~F.col("any_header"))).select(*cells.columns)


def html_tables(cells: DataFrame) -> DataFrame:
    """(doc, table_no, html): a table with a head if has_header()."""
    tagged = cells.join(has_header(cells), list(TABLE)).withColumn("tag", F.when((F.col("r") == 0) & F.col("header"), "th").otherwise("td"))
    tagged = tagged.withColumn("value", F.concat(F.lit("<"), "tag", F.lit(">"), F.replace(escape_html(F.col("value")), F.lit("\n"), F.lit("<br>")), F.lit("</"), "tag", F.lit(">")))
    rows = rows_of(tagged).select(*TABLE, "r", F.concat(F.lit("<tr>"), F.array_join("cells", ""), F.lit("</tr>")).alias("row"))
    whole = rows.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]), "").alias("body"))
    return whole.select(*TABLE, F.concat(F.lit("<table>"), "body", F.lit("</table>")).alias("html"))


def covered(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells with the merge that holds each (r0, c0, r1, c1 or null) and whether the cell is its anchor: merges spread to the places that they cover, joined by place."""
    place = merges.select(*TABLE, "r0", "c0", "r1", "c1", F.explode(F.sequence("r0", "r1")).alias("r")).select("*", F.explode(F.sequence("c0", "c1")).alias("c"))
    keys = [*TABLE, "r", "c"]
    joined = dealt(cells, *keys).join(dealt(place, *keys), keys, "left")
    return joined.select(*cells.columns, "r0", "c0", "r1", "c1", F.when(F.col("r0").isNotNull(), (F.col("r") == F.col("r0")) & (F.col("c") == F.col("c0"))).alias("anchor"))


def sheets(rows: DataFrame, most: int = 1_048_576) -> DataFrame:
    """Rows (doc, table_no, r, ...) with the sheet each falls on when the header is repeated on every sheet of `most` rows, and its row there."""
    body = F.col("r") - 1
    return rows.withColumns({"sheet": F.when(F.col("r") == 0, 0).otherwise(F.floor(body / (most - 1))).cast("int"), "sheet_row": F.when(F.col("r") == 0, 0).otherwise(body % (most - 1) + 1).cast("int")})


def first_rows(rows: DataFrame, most: int = 5000) -> DataFrame:
    """The first rows of each table for print, with the table's total."""
    total = rows.groupBy(*TABLE).agg(F.count("*").alias("total"))
    return rows.where(F.col("r") < most).join(total, list(TABLE)).select(*rows.columns, "total")


def folded(cells: DataFrame) -> DataFrame:
    """Rows whose first cell is empty continue the row above them, cell by cell."""
    starts = cells.groupBy(*TABLE, "r").agg((F.max(F.when(F.col("c") == 0, F.col("value"))) != "").alias("named"), F.bool_or(F.col("value") != "").alias("some"))
    order = Window.partitionBy(*TABLE).orderBy("r")
    groups = starts.withColumn("row", F.sum(F.when(F.col("named") | ~F.col("some") | (F.row_number().over(order) == 1), 1).otherwise(0)).over(order) - 1)
    joined = cells.join(groups.select(*TABLE, "r", "row"), [*TABLE, "r"]).where("value <> ''")
    parts = joined.groupBy(*TABLE, "row", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), " ").alias("value"))
    every = cells.select(*TABLE, "c").distinct().join(groups.select(*TABLE, "row").distinct(), list(TABLE))
    return every.join(parts, [*TABLE, "row", "c"], "left").select(*TABLE, F.col("row").cast("int").alias("r"), "c", F.coalesce("value", F.lit("")).alias("value"))


def wide_tables_dominate(measured: DataFrame, lengths: DataFrame, width: int = 95, share: float = 0.5) -> DataFrame:
    """(doc, wide_chars, dominate): whether tables wider than a page of `width` characters hold at least `share` of a document's text; lengths has (doc, chars)."""
    wide = measured.groupBy("doc").agg(F.sum(F.when(F.col("needed") > width, F.col("text_chars")).otherwise(0)).alias("wide_chars"))
    return lengths.join(wide, "doc", "left").select("doc", F.coalesce("wide_chars", F.lit(0)).alias("wide_chars"), F.coalesce((F.col("wide_chars") > 0) & (F.col("wide_chars") >= share * F.col("chars")), F.lit(False)).alias("dominate"))


def used_columns(cells: DataFrame, shown: int = 5000) -> DataFrame:
    """(doc, table_no, c, name): the columns of which one of the first `shown` rows below the header is filled; exports keep all columns, prints these."""
    name = F.max(F.when(F.col("r") == 0, F.col("value"))).alias("name")
    used = F.max((F.col("r").between(1, shown)) & (F.col("value") != "")).alias("used")
    return cells.groupBy(*TABLE, "c").agg(name, used).where("used").drop("used")


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): of an even number of values the larger middle one, which no percentile gives. The values of a key are numbered, not gathered."""
    order = Window.partitionBy(*keys)
    placed = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("median"), F.row_number().over(order.orderBy(value)).alias("_nth"), F.count("*").over(order).alias("_all"))
    return placed.where(F.col("_nth") == F.floor(F.col("_all") / 2) + 1).select(*keys, "median")
