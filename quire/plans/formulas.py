"""Formulas of the order lines: what each carries from the formulas before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import formulas
from quire.plans.common import read


def j9_carried_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's formulas, one a line: each defines a name by that of its part or of its supplier, by turns of the commands, and uses another."""
    letter = lambda c: F.concat(F.lit("\\m"), F.substring(F.lit("abcdefgh"), (F.col(c) % 8 + 1).cast("int"), F.lit(1)))
    own, other, n = letter("l_partkey"), letter("l_suppkey"), F.col("l_linenumber") % 4
    made = (
        F.when(n == 0, F.concat(F.lit("\\newcommand{"), own, F.lit("}[1][{]}]{"), other, F.lit("#1 \\{}")))
        .when(n == 1, F.concat(F.lit("\\def"), own, F.lit("#1.{ % "), letter("l_orderkey"), F.lit("\n "), other, F.lit("}")))
        .when(n == 2, F.concat(F.lit("\\let "), own, F.lit(" = "), other))
        .otherwise(F.concat(F.lit("\\newcommand{"), own, F.lit("}{"), other))  # never closed
    )
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.concat(made, F.lit(" x+"), letter("l_orderkey"), F.lit("\\\\def")).alias("tex"))
    once = rows.groupBy("doc", "pos").agg(F.min("tex").alias("tex"))
    drawn = formulas.carried(once)
    return drawn.select("doc", "pos", "n_carried", F.sha2("drawn", 256).alias("sha256"))


QUERIES = {"j9_carried_definitions": j9_carried_definitions}
ORACLE_SQL = {
    "j9_carried_definitions": r"""
WITH RECURSIVE k AS (SELECT l_orderkey AS doc, l_linenumber AS pos, '\m' || substr('abcdefgh', CAST(l_partkey % 8 + 1 AS BIGINT), 1) AS own, '\m' || substr('abcdefgh', CAST(l_suppkey % 8 + 1 AS BIGINT), 1) AS other,
  '\m' || substr('abcdefgh', CAST(l_orderkey % 8 + 1 AS BIGINT), 1) AS used FROM lineitem),
m AS (SELECT *, CASE pos % 4 WHEN 0 THEN '\newcommand{' || own || '}[1][{]}]{' || other || '#1 \{}' WHEN 1 THEN '\def' || own || '#1.{ % ' || used || chr(10) || ' ' || other || '}'
  WHEN 2 THEN '\let ' || own || ' = ' || other ELSE '\newcommand{' || own || '}{' || other END AS def FROM k),
f AS (SELECT doc, pos, min(def || ' x+' || used || '\\def') AS tex FROM m GROUP BY doc, pos),
g AS (SELECT DISTINCT m.doc, m.pos, own, other, used, def, tex FROM m JOIN f ON m.doc = f.doc AND m.pos = f.pos AND def || ' x+' || used || '\\def' = tex),
d AS (SELECT doc, pos AS made, own AS name, other AS use, def FROM g WHERE pos % 4 < 3 AND NOT (pos % 4 = 0 AND NOT ends_with(def, '\{}') )),
need AS (SELECT doc, pos, unnest([own, other, used]) AS name FROM g UNION SELECT need.doc, need.pos, d.use FROM need JOIN d ON need.doc = d.doc AND need.name = d.name AND d.made < need.pos),
got AS (SELECT need.doc, need.pos, count(*) AS n, string_agg(def, '' ORDER BY made) AS before FROM need JOIN d ON need.doc = d.doc AND need.name = d.name AND d.made < need.pos GROUP BY need.doc, need.pos)
SELECT g.doc, g.pos, CAST(coalesce(n, 0) AS INTEGER) AS n_carried, sha256(coalesce(before, '') || tex) AS sha256 FROM g LEFT JOIN got ON g.doc = got.doc AND g.pos = got.pos""",
}
