"""Styles, nested lists and cut lists made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import lists
from quire.plans.common import read


def j10_style_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as styles: based on an earlier part of their brand's number, on themselves, on each other, or on none; some have a font."""
    k = F.col("p_partkey")
    based = F.when(k % 97 == 0, k).when(k % 101 == 0, k + 1).when(k % 89 == 0, -k).when(k % 23 == 0, None).otherwise(k - 1 - k % 2)
    styles = read(spark, sf_dir, "part").select(F.lit("all").alias("doc"), k.alias("id"), based.alias("based_on"), F.when(k % 40 == 1, F.col("p_brand")).alias("font"), F.when(k % 7 == 0, F.col("p_type")).alias("jc"))
    made = lists.inherited(styles, ["font", "jc"])
    return made.select(F.col("id").alias("p_partkey"), F.size("chain").alias("styles"), F.element_at("chain", -1).alias("last"), "font", "jc")


def j10_list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as paragraphs of two lists with three levels, which begin at different numbers."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos")).agg((F.min("l_partkey") % 2).cast("int").alias("list"), (F.min("l_suppkey") % 3).cast("int").alias("level"))
    starts = rows.select("list", "level").distinct().where("level > 0").withColumn("start", F.col("level") * 10 - F.col("list"))
    return lists.numbered(rows, starts).select("doc", "pos", "number")


def z3_rejoined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as lists, of which some were cut by what stands between them."""
    k = F.col("o_orderkey")
    inner = F.concat(F.lit("<li>"), k.cast("string"), F.when(k % 11 == 0, "</li>x").otherwise("</li>\n"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("n"), F.when(F.col("o_orderstatus") == "P", "ul").otherwise("ol").alias("tag"), (F.floor(k / 2) % 3).alias("first_id"), (k % 3).alias("last_id"), inner.alias("inner"), F.when(k % 2 == 0, "<p>b</p> ").otherwise(" ").alias("after"))
    return lists.rejoined(rows).select(F.col("doc").alias("o_custkey"), "n", "parts", "html")


QUERIES = {f.__name__: f for f in (j10_style_chains, j10_list_numbers, z3_rejoined_lists)}
ORACLE_SQL = {
    "j10_style_chains": """
WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 97 = 0 THEN p_partkey WHEN p_partkey % 101 = 0 THEN p_partkey + 1 WHEN p_partkey % 89 = 0 THEN -p_partkey WHEN p_partkey % 23 = 0 THEN NULL ELSE p_partkey - 1 - p_partkey % 2 END AS based,
  CASE WHEN p_partkey % 40 = 1 THEN p_brand END AS font, CASE WHEN p_partkey % 7 = 0 THEN p_type END AS jc FROM part),
c AS (SELECT id, id AS cur, 1 AS depth, [id] AS seen FROM s UNION ALL SELECT c.id, n.id, depth + 1, seen || [n.id] FROM c JOIN s ON s.id = c.cur JOIN s n ON n.id = s.based WHERE depth < 16 AND NOT list_contains(seen, n.id))
SELECT c.id AS p_partkey, CAST(max(depth) AS INTEGER) AS styles, arg_max(cur, depth) AS last, arg_min(font, depth) FILTER (font IS NOT NULL) AS font, arg_min(jc, depth) FILTER (jc IS NOT NULL) AS jc FROM c JOIN s ON s.id = c.cur GROUP BY c.id""",
    "j10_list_numbers": """
WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS pos, min(l_partkey) % 2 AS list, min(l_suppkey) % 3 AS level FROM lineitem GROUP BY doc, pos),
r AS (SELECT p.doc, p.pos, p.list, p.level, coalesce(max(h.pos), -1) AS since FROM p LEFT JOIN p h ON h.doc = p.doc AND h.list = p.list AND h.level < p.level AND h.pos < p.pos GROUP BY ALL)
SELECT doc, pos, CAST(row_number() OVER (PARTITION BY doc, list, level, since ORDER BY pos) - 1 + CASE WHEN level > 0 THEN level * 10 - list ELSE 1 END AS INTEGER) AS number FROM r""",
    "z3_rejoined_lists": """
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS n, CASE WHEN o_orderstatus = 'P' THEN 'ul' ELSE 'ol' END AS tag, (o_orderkey // 2) % 3 AS f, o_orderkey % 3 AS l, o_orderkey % 11 <> 0 AS whole, o_orderkey % 2 = 0 AS b FROM orders),
g AS (SELECT *, coalesce(tag = 'ol' AND lead(tag) OVER w = 'ol' AND l = lead(f) OVER w AND whole, false) AS goes FROM o WINDOW w AS (PARTITION BY doc ORDER BY n)),
h AS (SELECT *, sum(CASE WHEN before THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY n) AS k FROM (SELECT *, coalesce(lag(goes) OVER (PARTITION BY doc ORDER BY n), false) AS before FROM g))
SELECT doc AS o_custkey, min(n) AS n, CAST(count(*) AS INTEGER) AS parts, '<' || min(tag) || '>' || string_agg('<li>' || n || CASE WHEN goes AND b THEN '<p>b</p></li>' WHEN whole THEN '</li>' || chr(10) ELSE '</li>x' END, '' ORDER BY n) || '</' || min(tag) || '>'
  || arg_max(CASE WHEN b THEN '<p>b</p> ' ELSE ' ' END, n) AS html FROM h GROUP BY doc, k""",
}
