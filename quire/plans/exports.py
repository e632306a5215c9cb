"""Order lines written as files by their tasks and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import jsontext
from quire.operators.stored import shared_dir
from quire.plans.common import read
from quire.sources import files, records, workbooks

COLUMNS = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "note")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines with a note that holds what each format has to escape."""
    note = F.concat(F.lit('a "b", <&>_x000D_\n '), F.col("l_partkey").cast("string"), F.lit("\x07é"))
    return read(spark, sf_dir, "lineitem").withColumn("note", F.when(F.col("l_partkey") % 3 == 0, note).when(F.col("l_partkey") % 3 == 1, F.col("l_suppkey").cast("string"))).select(*COLUMNS)


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"


def _typed(cells: DataFrame) -> DataFrame:
    kinds = {"l_orderkey": "long", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double"}
    return cells.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS[:-1]], F.sha2(F.coalesce("note", F.lit("")), 256).alias("note_sha256"))


def k5_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as workbooks whose sheets hold 1,000 rows, found as files and read row by row."""
    place = _place(spark)
    workbooks.write_workbooks(_lines(spark, sf_dir), place, most_rows=1000)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(place).select(F.col("path").alias("doc"), "content")
    rows = files.workbook_rows(found).where("error is null and r > 0")
    value = lambda k: F.try_element_at("values", F.nullif(F.array_position("columns", k), F.lit(0)).cast("int"))
    plain = lambda v: F.replace(F.regexp_replace(v, "_x0007_", "\x07"), F.lit("_x005F_"), F.lit("_"))
    return _typed(rows.select(*[plain(value(k)).alias(c) for k, c in enumerate(COLUMNS)]))


def k4_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON Lines and read as records, number by number as it was written."""
    place = _place(spark)
    workbooks.write_json_lines(_lines(spark, sf_dir), place)
    lines = spark.read.text(place).select(F.input_file_name().alias("doc"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))
    rows = jsontext.records(lines, line_no="line_no")
    return _typed(rows.select(*[F.col("fields")[c].alias(c) for c in COLUMNS]))


def k4_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as csv files and read as tables."""
    place = _place(spark)
    workbooks.write_csv(_lines(spark, sf_dir), place)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(place).select(F.col("path").alias("doc"), F.decode("content", "UTF-8").alias("text"))
    rows = records.csv_rows(found).where("error is null and r > 0")
    return _typed(rows.select(*[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(COLUMNS)]))


QUERIES = {f.__name__: f for f in (k5_workbooks, k4_json_lines, k4_csv)}
_SQL = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag,
  sha256(CASE l_partkey % 3 WHEN 0 THEN 'a "b", <&>_x000D_' || chr(10) || ' ' || l_partkey || chr(7) || 'é' WHEN 1 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END) AS note_sha256 FROM lineitem"""
ORACLE_SQL = dict.fromkeys(QUERIES, _SQL)
