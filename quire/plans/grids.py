"""Grid operators over cells unpivoted from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.numbers import CANONICAL, EXPONENT, NUMERIC, TINY
from quire.operators import cells as C
from quire.operators import geometry
from quire.operators.stored import stored
from quire.plans.common import read


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table a region: its nations, after a header."""
    return C.unpivot(read(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], doc=F.col("n_regionkey"), order=["n_nationkey"])


def _part(spark: SparkSession, sf_dir: str, header: bool = True) -> DataFrame:
    """One table a brand; brands are few, so their tables are long."""
    return C.unpivot(read(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_type", "p_size", "p_brand"], doc=F.col("p_brand"), order=["p_partkey"], header=header, long=True)


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table a customer: its orders, with every third cell blank and rows of one to four cells."""
    orders = C.unpivot(read(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderstatus"], doc=F.col("o_custkey"), order=["o_orderkey"], header=False)
    width = F.when(F.col("r") % 5 == 4, 1).otherwise(F.col("doc").cast("int") % 4 + 1)
    return orders.where(F.col("c") < width).withColumn("value", F.when((F.col("r") + F.col("c")) % 3 == 2, "").otherwise(F.col("value")))


def k1_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.csv_lines(_part(spark, sf_dir)).select("doc", "r", "line")


def k2_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.json_rows(_part(spark, sf_dir)).select("doc", "r", "row")


def k7_pipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pipe_rows(_nation(spark, sf_dir)).select("doc", "line_no", "line")


def c3_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.html_tables(_nation(spark, sf_dir)).select("doc", "html")


def g9_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.has_header(_part(spark, sf_dir)).unionByName(C.has_header(_part(spark, sf_dir, header=False)).withColumn("table_no", F.lit(1))).select("doc", "table_no", "header")


def p4_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trim_trailing(_ragged(spark, sf_dir)).select("doc", "r", "c", "value")


def p6_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_content(_ragged(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("n_cells"))


def a2_modal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.modal_columns(_ragged(spark, sf_dir)).select("doc", "n_rows", "modal", "tabular")


def a4_page_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_fit(C.measures(_part(spark, sf_dir))).select("doc", "needed", "columns", "text_chars", "fits", "suggestion")


def p14_marker_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumns({"mark": F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, ".").otherwise(""))})
    marked = C.unpivot(lines, ["mark", "l_returnflag"], doc=F.col("l_orderkey"), order=["l_linenumber", "l_partkey", "l_suppkey"], header=False)
    return C.marker_columns(marked).select("doc", "c", F.round("share", 9).alias("share"))


def k6_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).where("c = 0").select("doc", "table_no", "r")
    return C.sheets(rows, 20).select("doc", "r", "sheet", "sheet_row")


def s5_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_rows(_part(spark, sf_dir).where("c = 0"), 15).select("doc", "r", "value", "total")


def j11_covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stored(_part(spark, sf_dir))
    merges = parts.where("r % 4 = 1 and c % 2 = 0").select("doc", "table_no", F.col("r").alias("r0"), F.col("c").alias("c0"), (F.col("r") + 2).alias("r1"), (F.col("c") + F.col("r") % 8 % 2).cast("int").alias("c1"))
    return C.covered(parts, merges).select("doc", "r", "c", "r0", "c0", "r1", "c1", "anchor")


def w6_folded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    blanked = _part(spark, sf_dir).withColumn("value", F.when((F.col("r") % 3 > 0) & F.col("c").isin(0, 3), "").when(F.col("r") % 7 == 6, "").otherwise(F.col("value")))
    return C.folded(blanked).select("doc", "r", "c", "value")


def a3_upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median (of an even number, the larger middle one), which no percentile gives."""
    return C.upper_medians(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice")


def a9_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean confidence of the words of a line that are not blank and whether it is high enough to be read."""
    found = geometry.mean_confidence(read(spark, sf_dir, "events"), ["user_id"], "event_type", "value")
    return found.withColumn("mean", F.round("mean", 6)).withColumn("readable", F.col("mean") >= 70)


QUERIES = {f.__name__: f for f in (k1_csv_lines, k2_json_rows, k7_pipe_rows, c3_html_tables, g9_headers, p4_trimmed, p6_with_content, a2_modal_columns, a4_page_fit, p14_marker_columns, k6_sheets, s5_first_rows, j11_covered_cells, w6_folded_rows, a3_upper_medians, a9_confidence)}

_PART_BODY = "SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, [CAST(p_partkey AS VARCHAR), p_name, p_type, CAST(p_size AS VARCHAR), p_brand] AS v FROM part"
_PART = f"part_rows AS ({_PART_BODY} UNION ALL SELECT DISTINCT p_brand, 0, ['p_partkey', 'p_name', 'p_type', 'p_size', 'p_brand'] FROM part), cells AS (SELECT doc, r, c, v[c + 1] AS value FROM part_rows, range(5) t(c))"
_NATION = "rows AS (SELECT CAST(n_regionkey AS VARCHAR) AS doc, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, [CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)] AS v FROM nation UNION ALL SELECT DISTINCT CAST(n_regionkey AS VARCHAR), 0, ['n_nationkey', 'n_name', 'n_regionkey'] FROM nation)"
_RAGGED = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, [CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, o_orderstatus] AS v FROM orders),
cells AS (SELECT doc, r, c, CASE WHEN (r + c) % 3 = 2 THEN '' ELSE v[c + 1] END AS value FROM o, range(4) t(c) WHERE c < CASE WHEN r % 5 = 4 THEN 1 ELSE o_custkey % 4 + 1 END)"""
_NUM = f"(trim(value) <> '' AND regexp_matches(replace(trim(value), ',', ''), '{NUMERIC}'))"
_TYPED = f"(trim(x) <> '' AND length(trim(x)) <= 15 AND ((regexp_matches(trim(x), '{CANONICAL}') AND NOT regexp_matches(trim(x), '{TINY}')) OR regexp_matches(trim(x), '{EXPONENT}')))"
_WIDTHS = sorted((w, f"{s} {'landscape' if l else 'portrait'}") for s, l, w in C.SETUPS)
ORACLE_SQL = {
    "k1_csv_lines": f"""WITH {_PART} SELECT doc, r, array_to_string(list_transform(v, lambda x: CASE WHEN regexp_matches(x, '[",\\n\\r]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), ',') AS line FROM part_rows""",
    "k2_json_rows": f"""WITH {_PART} SELECT doc, r, '{{' || array_to_string(list_transform(range(5), lambda i: '"' || (['p_partkey', 'p_name', 'p_type', 'p_size', 'p_brand'])[i + 1] || '": ' || j[i + 1]), ', ') || '}}' AS row
 FROM (SELECT doc, r, list_transform(v, lambda x: CASE WHEN {_TYPED} THEN trim(x) ELSE '"' || replace(replace(x, '\\', '\\\\'), '"', '\\"') || '"' END) AS j FROM part_rows WHERE r > 0)""",
    "k7_pipe_rows": f"WITH {_NATION} SELECT doc, CASE WHEN r = 0 THEN 0 ELSE r + 1 END AS line_no, '| ' || array_to_string(list_transform(v, lambda x: replace(x, '|', '\\|')), ' | ') || ' |' AS line FROM rows UNION ALL SELECT DISTINCT doc, 1, '| --- | --- | --- |' FROM rows",
    "c3_html_tables": f"WITH {_NATION} SELECT doc, '<table>' || string_agg('<tr>' || array_to_string(list_transform(v, lambda x: CASE WHEN r = 0 THEN '<th>' || x || '</th>' ELSE '<td>' || x || '</td>' END), '') || '</tr>', '' ORDER BY r) || '</table>' AS html FROM rows GROUP BY doc",
    "g9_headers": f"WITH {_PART} SELECT doc, 0 AS table_no, NOT bool_or(r = 0 AND {_NUM}) AND bool_or(r > 0 AND {_NUM}) AS header FROM cells GROUP BY doc UNION ALL SELECT doc, 1, NOT bool_or(r = 1 AND {_NUM}) AND bool_or(r > 1 AND {_NUM}) FROM cells WHERE r > 0 GROUP BY doc",
    "p4_trimmed": f"WITH {_RAGGED}, m AS (SELECT *, max(r) FILTER (WHERE trim(value) <> '') OVER (PARTITION BY doc) AS lr, max(c) FILTER (WHERE trim(value) <> '') OVER (PARTITION BY doc) AS lc FROM cells) SELECT doc, r, c, value FROM m WHERE lr IS NULL OR (r <= lr AND c <= lc)",
    "p6_with_content": f"WITH {_RAGGED} SELECT doc, count(*) AS n_cells FROM cells GROUP BY doc HAVING bool_or(trim(value) <> '')",
    "a2_modal_columns": f"WITH {_RAGGED}, n AS (SELECT doc, r, count(*) AS n FROM cells GROUP BY ALL), h AS (SELECT doc, n, count(*) AS hits FROM n GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY hits DESC, n DESC) AS k, sum(hits) OVER (PARTITION BY doc) AS n_rows FROM h) SELECT doc, CAST(n_rows AS BIGINT) AS n_rows, n AS modal, n_rows >= 2 AND n >= 2 AND hits * 5 >= n_rows * 4 AS tabular FROM b WHERE k = 1",
    "a4_page_fit": f"WITH {_PART}, w AS (SELECT doc, c, greatest(3, least(24, max(list_max(list_transform(regexp_split_to_array(value, '\\s+'), lambda x: length(x)))))) AS w, sum(length(regexp_replace(value, '\\s+', '', 'g'))) AS t FROM cells GROUP BY ALL), m AS (SELECT doc, CAST(sum(w + 3) AS BIGINT) AS needed, count(*) AS columns, CAST(sum(t) AS BIGINT) AS text_chars FROM w GROUP BY doc) SELECT *, needed <= 95 AS fits, CASE WHEN needed <= 95 THEN NULL " + " ".join(f"WHEN needed <= {w} THEN '{n}'" for w, n in _WIDTHS) + f" ELSE '{_WIDTHS[-1][1]}' END AS suggestion FROM m",
    "p14_marker_columns": """SELECT CAST(l_orderkey AS VARCHAR) AS doc, 0 AS c, 1.0 AS share FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey""",
    "k6_sheets": f"WITH {_PART} SELECT doc, r, CASE WHEN r = 0 THEN 0 ELSE (r - 1) // 19 END AS sheet, CASE WHEN r = 0 THEN 0 ELSE (r - 1) % 19 + 1 END AS sheet_row FROM part_rows",
    "s5_first_rows": f"WITH {_PART} SELECT doc, r, v[1] AS value, total FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS total FROM part_rows) WHERE r < 15",
    "j11_covered_cells": f"WITH {_PART}, m AS MATERIALIZED (SELECT doc, r AS r0, c AS c0, r + 2 AS r1, c + r % 8 % 2 AS c1 FROM cells WHERE r % 4 = 1 AND c % 2 = 0), w AS MATERIALIZED (SELECT doc, r0, c0, r1, c1, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM m)) SELECT cells.doc, cells.r, cells.c, r0, c0, r1, c1, CASE WHEN r0 IS NOT NULL THEN cells.r = r0 AND cells.c = c0 END AS anchor FROM cells LEFT JOIN w ON cells.doc = w.doc AND cells.r = w.r AND cells.c = w.c",
    "w6_folded_rows": f"WITH {_PART}, b AS (SELECT doc, r, c, CASE WHEN r % 3 > 0 AND c IN (0, 3) THEN '' WHEN r % 7 = 6 THEN '' ELSE value END AS value FROM cells), s AS (SELECT doc, r, max(value) FILTER (WHERE c = 0) <> '' OR max(value) = '' OR r = 0 AS start FROM b GROUP BY doc, r), g AS (SELECT doc, r, sum(CAST(start AS INT)) OVER (PARTITION BY doc ORDER BY r) - 1 AS row FROM s) SELECT b.doc, CAST(row AS INT) AS r, c, coalesce(string_agg(value, ' ' ORDER BY b.r) FILTER (WHERE value <> ''), '') AS value FROM b JOIN g ON b.doc = g.doc AND b.r = g.r GROUP BY b.doc, row, c",
    "a3_upper_medians": "SELECT l_orderkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_orderkey",
    "a9_confidence": "SELECT user_id, round(avg(value), 6) AS mean, count(*) AS n, round(avg(value), 6) >= 70 AS readable FROM events WHERE trim(event_type) <> '' GROUP BY user_id",
}
