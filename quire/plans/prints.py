"""The order lines as tables of one document, cut for printing, and printed pages read back as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import chunks, regions
from quire.plans.common import read


def c7_print_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of all lines: a table a thousand orders, rows of one to three rows and some cells, a few past every budget."""
    key = ["l_orderkey", "l_linenumber"]
    lines = read(spark, sf_dir, "lineitem").groupBy(*key).agg(F.max("l_quantity").alias("q"))
    loads = lines.select(
        F.lit("all").alias("doc"), F.floor(F.col("l_orderkey") / 1000).alias("table_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"),
        F.when(F.col("q") == 50, 1 + F.col("l_orderkey") % 3).otherwise(1).alias("n_rows"), F.when((F.col("l_orderkey") % 997 == 0) & (F.col("l_linenumber") == 1), 20_000).otherwise(F.col("l_linenumber") + F.col("q")).alias("n_cells"),
    )
    cut = chunks.print_chunks(loads, 500, 12_000)
    return cut.groupBy("chunk").agg(F.count("*").alias("rows"), F.sum("n_rows").alias("n_rows"), F.sum("n_cells").alias("n_cells"), F.min("r").alias("first"), F.max("r").alias("last"))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts printed as a dense table, a page a brand and kind: type, name and price, 4.5 points a character; the name wraps into a
    second line after its first word on odd keys, and the name and price of every fourth row, from the third, come as one item (two
    items by themselves are what shows a column). Texts of pages are printed below as prose."""
    p = read(spark, sf_dir, "part").select("*", F.concat_ws("/", "p_brand", "p_type").alias("doc"))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("p_partkey")))
    width, price = 4.5, F.format_string("%.2f", "p_retailprice")
    words = F.split(F.concat_ws(" ", "p_name", "p_name"), " ")
    wraps = (F.col("p_partkey") % 2 == 1) & (F.size(words) > 1)
    upper = F.when(wraps, words[0]).otherwise(F.array_join(words, " "))
    lower = F.when(wraps, F.array_join(F.slice(words, 2, F.size(words)), " "))
    one = F.col("k") % 4 == 3
    y = 100_000.0 - F.col("k") * 26

    def item(at: int, text: Column, x0: float, y: Column, eol: bool) -> Column:
        return F.struct((F.col("k") * 10 + at).alias("n"), text.alias("text"), F.lit(x0).alias("x0"), (F.lit(x0) + F.length(text) * width).alias("x1"), y.alias("y"), F.lit(eol).alias("eol"))

    # One item for two cells: spaces fill the way to the second cell's place.
    together = F.concat(F.rpad(upper, 26, " "), F.lit(" "), price)
    rows = F.array(
        item(0, F.col("p_partkey").cast("string"), 36.0, y, False),
        F.when(one, item(1, together, 100.0, y, True)).otherwise(item(1, upper, 100.0, y, False)),
        F.when(~one, item(2, price, 222.0, y, True)),
        F.when(lower.isNotNull(), item(3, lower, 100.0, y - 13, True)),
    )
    table = p.select("doc", F.lit(0).alias("page"), F.explode(F.array_compact(rows)).alias("i")).select("doc", "page", "i.*")
    prose = read(spark, sf_dir, "documents").select(F.concat(F.lit("prose"), F.col("doc_id").cast("string")).alias("doc"), F.lit(0).alias("page"), F.posexplode(F.split(F.col("text"), r"\s+")).alias("n", "text"))
    prose = prose.where("text <> ''").select("doc", "page", F.col("n").cast("bigint").alias("n"), "text", (36.0 + (F.col("n") % 10) * 50).alias("x0"), (36.0 + (F.col("n") % 10) * 50 + 47).alias("x1"), (1000.0 - F.floor(F.col("n") / 10) * 13).alias("y"), (F.col("n") % 10 == 9).alias("eol"))
    return table.unionByName(prose).withColumn("height", F.lit(9.0))


def g5_printed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every printed table of three parts or more; prose gives none."""
    found = regions.tables(_printed(spark, sf_dir))
    rows = found.groupBy("doc", "region", "r").pivot("c", [0, 1, 2, 3]).agg(F.first("value"))
    return rows.select("doc", F.col("0").alias("key"), F.col("1").alias("name"), F.col("2").alias("price"), F.col("3").alias("more"))


QUERIES = {"c7_print_chunks": c7_print_chunks, "g5_printed_tables": g5_printed_tables}
ORACLE_SQL = {
    "g5_printed_tables": """SELECT p_brand || '/' || p_type AS doc, CAST(p_partkey AS VARCHAR) AS key, p_name || ' ' || p_name AS name, format('{:.2f}', p_retailprice) AS price, NULL AS more FROM part
QUALIFY count(*) OVER (PARTITION BY p_brand, p_type) >= 3""",
    "c7_print_chunks": """
WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY o, n),
w AS MATERIALIZED (SELECT floor(o / 1000) AS t, o * 10 + n AS r, CASE WHEN q = 50 THEN 1 + o % 3 ELSE 1 END AS a, CAST(CASE WHEN o % 997 = 0 AND n = 1 THEN 20000 ELSE n + q END AS BIGINT) AS c FROM l),
s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY r) AS p, sum(a) OVER (ORDER BY r) AS sa, sum(c) OVER (ORDER BY r) AS sc, coalesce(t <> lag(t) OVER (ORDER BY r), true) AS first FROM w),
b AS (SELECT CAST(1 AS BIGINT) AS p UNION ALL SELECT x FROM (SELECT min(CASE WHEN j.p > b.p AND CASE WHEN j.first THEN j.sa - j.a - (i.sa - i.a) >= 500 OR j.sc - j.c - (i.sc - i.c) >= 12000 ELSE j.sa - (i.sa - i.a) > 500 OR j.sc - (i.sc - i.c) > 12000 END THEN j.p END) AS x
  FROM b JOIN s i ON i.p = b.p CROSS JOIN s j) WHERE x IS NOT NULL),
n AS MATERIALIZED (SELECT p AS begin, row_number() OVER (ORDER BY p) - 1 AS chunk, lead(p, 1, 9223372036854775807) OVER (ORDER BY p) AS until FROM b),
k AS (SELECT s.*, chunk FROM s JOIN n ON p >= begin AND p < until)
SELECT chunk, count(*) AS rows, CAST(sum(a) AS BIGINT) AS n_rows, CAST(sum(c) AS BIGINT) AS n_cells, min(r) AS first, max(r) AS last FROM k GROUP BY chunk""",
}
