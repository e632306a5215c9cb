"""Heading anchors over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import github_slug


def w3_heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of the pages' titles within a site, numbered where they repeat."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    slug = pages.select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), github_slug(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("slug"))
    nth = F.row_number().over(Window.partitionBy("host", "slug").orderBy("page_id")) - 1
    return slug.select("page_id", "host", F.when(nth > 0, F.concat("slug", F.lit("-"), nth.cast("string"))).otherwise(F.col("slug")).alias("anchor"))


QUERIES = {"w3_heading_anchors": w3_heading_anchors}
ORACLE_SQL = {
    "w3_heading_anchors": r"""
WITH s AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host,
  replace(regexp_replace(lower(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))), '[^\p{L}\p{M}\p{N}\p{Pc}\- ]', '', 'g'), ' ', '-') AS slug FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY host, slug ORDER BY page_id) - 1 AS k FROM s)
SELECT page_id, host, CASE WHEN k > 0 THEN slug || '-' || k ELSE slug END AS anchor FROM n""",
}
