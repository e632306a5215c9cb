"""Structured Streaming forms of the record and caption operators.

The engine that this one follows has no streams; these are extensions, named as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the records of JSON Lines files as they arrive; lines that are no records come with their text in `bad`."""
    return spark.readStream.schema(f"{schema}, bad string").option("columnNameOfCorruptRecord", "bad").json(path)


def pauses(events: DataFrame, key: str, at: str, pause: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(key, start, end, n): the events of a key in sessions, ended by a pause; state goes when the watermark passes a session."""
    marked = events.withWatermark(at, late)
    return marked.groupBy(key, F.session_window(at, pause).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
