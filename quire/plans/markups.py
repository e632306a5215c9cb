"""XML texts made from orders and their lines: laid out again, searched, and read as outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import markup
from quire.plans.common import read


def _lines(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """(l_orderkey, lines): the lines of an order as one text, each written by `line`, repeated ones once."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(line).alias("line"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", "line")))["line"], "").alias("lines"))


def x4_reindented_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of elements, of text, of both, kept space and comments; in every ninth order a tag does not match."""
    n = F.col("l_linenumber")
    line = (
        F.when(n % 3 == 0, F.concat(F.lit("<line>  <q>"), n.cast("string"), F.lit("</q><e/>\n<!-- c --> </line>")))
        .when(n % 3 == 1, F.concat(F.lit("<p> a <b>"), F.col("l_returnflag"), F.lit("</b> <i><u/></i></p>")))
        .otherwise(F.lit('<k xml:space = "preserve"> <x> </x> </k><d><![CDATA[<z>]]></d><empty> </empty>'))
    )
    lines = _lines(spark, sf_dir, line)
    text = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE o [<!ENTITY a "b">]>\n<o>'), "lines", F.when(F.col("l_orderkey") % 9 == 0, "</p></o>").otherwise("</o>"), F.lit("\n"))
    made = markup.reindented(lines.select(F.col("l_orderkey").alias("doc"), text.alias("text")))
    return made.select(F.col("doc").cast("long").alias("l_orderkey"), F.sha2("xml", 256).alias("sha256"))


def x5_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost a and b of every order, whose lines nest a in a and leave other tags open; every fifth order's last b never ends."""
    n = F.col("l_linenumber")
    line = F.when(n % 2 == 0, F.concat(F.lit("<a x='1'><b>"), n.cast("string"), F.lit("<a/><a>in</a></b><r></a>-"))).otherwise(F.concat(F.lit("<b/><ab>"), F.col("l_linestatus"), F.lit("</ab><q>")))
    text = F.concat("lines", F.when(F.col("l_orderkey") % 5 == 0, "<b>to <a>the</a> end").otherwise(""))
    found = markup.elements(_lines(spark, sf_dir, line).select(F.col("l_orderkey").alias("doc"), text.alias("text")), ["a", "b"])
    return found.groupBy(F.col("doc").cast("long").alias("l_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "inner"))), lambda x: F.concat(x["name"], F.lit("="), x["inner"])), ";").alias("found"))


def r13_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as an outline, their lines below them; texts, titles, links and notes come and go."""
    n = F.col("l_linenumber")
    line = F.concat(
        F.lit('<outline title="T&amp;'), n.cast("string"), F.when(n % 2 == 0, F.concat(F.lit("\" text='&#233;&#x41;"), F.col("l_returnflag"), F.lit("'"))).otherwise('"'),
        F.when(n % 3 == 0, ' xmlUrl="ftp://x" url=" HTTP://y/&lt;z " ').when(n % 3 == 1, " _note='a\n\"b\"'").otherwise(""), F.lit("/>"),
    )
    orders = _lines(spark, sf_dir, line).join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = F.concat(F.lit('<Outline text="'), F.col("o_orderkey").cast("string"), F.lit('" htmlUrl="mailto:a@b" title="no">'), "lines", F.lit("</Outline>"))
    text = F.concat(F.lit("<opml><head><title> C "), F.col("o_custkey").cast("string"), F.lit(" &amp; </title></head><body>"), F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", order.alias("x"))))["x"], " "), F.lit("</body></opml>"))
    return markup.outlines(orders.groupBy("o_custkey").agg(text.alias("text")), doc="o_custkey").select(F.col("doc").cast("long").alias("o_custkey"), "title", "n", "parent", "depth", "text", "link", "note")


QUERIES = {f.__name__: f for f in (x4_reindented_xml, x5_elements, r13_outlines)}
_LINES = "l AS (SELECT l_orderkey, l_linenumber AS n, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber)"
ORACLE_SQL = {
    "x4_reindented_xml": rf"""WITH {_LINES}
SELECT l_orderkey, CASE WHEN l_orderkey % 9 <> 0 THEN sha256('<?xml version="1.0"?>' || chr(10) || '<!DOCTYPE o [<!ENTITY a "b">]>' || chr(10) || '<o>' || chr(10) || string_agg(CASE n % 3
  WHEN 0 THEN '  <line>' || chr(10) || '    <q>' || n || '</q>' || chr(10) || '    <e/>' || chr(10) || '    <!-- c -->' || chr(10) || '  </line>' WHEN 1 THEN '  <p> a <b>' || f || '</b> <i><u/></i></p>'
  ELSE '  <k xml:space = "preserve"> <x> </x> </k>' || chr(10) || '  <d><![CDATA[<z>]]></d>' || chr(10) || '  <empty> </empty>' END, chr(10) ORDER BY n) || chr(10) || '</o>') END AS sha256 FROM l GROUP BY l_orderkey""",
    "x5_elements": rf"""WITH {_LINES},
p AS (SELECT l_orderkey, n, CASE WHEN n % 2 = 0 THEN 'a=<b>' || n || '<a/><a>in</a></b><r>' ELSE 'b=' END AS x FROM l UNION ALL SELECT DISTINCT l_orderkey, 99, 'b=to <a>the</a> end' FROM l WHERE l_orderkey % 5 = 0)
SELECT l_orderkey, string_agg(x, ';' ORDER BY n) AS found FROM p GROUP BY l_orderkey""",
    "r13_outlines": rf"""WITH {_LINES},
i AS (SELECT o_custkey, o_orderkey, 0 AS k, CAST(o_orderkey AS VARCHAR) AS text, 'mailto:a@b' AS link, NULL AS note FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l)
  UNION ALL SELECT o_custkey, o_orderkey, n, CASE WHEN n % 2 = 0 THEN 'éA' || f ELSE 'T&' || n END, CASE WHEN n % 3 = 0 THEN 'HTTP://y/<z' END, CASE WHEN n % 3 = 1 THEN 'a' || chr(10) || '"b"' END FROM l JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, k) - 1 AS n FROM i)
SELECT o_custkey, 'C ' || o_custkey || ' &' AS title, CAST(n AS INTEGER) AS n, CAST(CASE WHEN k > 0 THEN max(CASE WHEN k = 0 THEN n END) OVER (PARTITION BY o_custkey, o_orderkey) END AS INTEGER) AS parent,
  CASE WHEN k = 0 THEN 1 ELSE 2 END AS depth, text, link, note FROM r""",
}
