"""Pictures made of parts: their headers say a part's number and size in every format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import pictures
from quire.operators.ranges import dealt
from quire.plans.common import read


def _hex(value: Column, n: int, big: bool = True) -> Column:
    text = F.lpad(F.hex(value), 2 * n, "0")
    return text if big else F.concat(*[F.substring(text, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, content): a part in one of twelve formats, 100 + its size wide and 1 + its key modulo 10,000 high. The small table of parts, a file of few blocks, is many tasks' work."""
    w, h, k = (100 + F.col("p_size")).cast("long"), 1 + F.col("p_partkey") % 10_000, F.col("p_partkey") % 12
    one, none = F.lit(1), F.lit("")
    segment = F.concat(F.lit("FFE0"), _hex(F.lit(18), 2), F.lit("00" * 16))
    exif = lambda turn: F.concat(F.lit("FFE1"), _hex(F.lit(2 + 6 + 8 + 2 + 24), 2), F.lit("457869660000" + "4D4D002A00000008" + "0002" + "010000030000000100010000" + "01120003" + "00000001"), _hex(turn, 2), F.lit("0000"))
    frame = F.concat(F.lit("FFC2000B08"), _hex(h, 2), _hex(w, 2), F.lit("0000000000"))
    jpeg = lambda before: F.concat(F.lit("FFD8"), before, frame)
    entry = lambda tag, kind, value: F.concat(_hex(F.lit(tag), 2, False), _hex(F.lit(kind), 2, False), _hex(one, 4, False), _hex(value, 4, False))
    directory = lambda after, subfile: F.concat(F.lit("0300"), entry(254, 4, subfile), entry(256, 4, w), entry(257, 4, h), after)
    # A directory is 42 bytes; the first stands at 8, the second at 50.
    two = F.concat(F.lit("49492A0008000000"), directory(F.lit("32000000"), F.lit(0)), directory(F.lit("00000000"), F.col("p_partkey") % 2))
    loop = F.concat(F.lit("49492A0008000000"), directory(F.lit("08000000"), F.lit(0)))
    formats = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 4), _hex(h, 4)), jpeg(F.repeat(segment, (F.col("p_size") * 3).cast("int"))), jpeg(F.concat(F.lit("FFFF"), exif(F.lit(6)))), jpeg(F.concat(exif(F.lit(3)), F.lit("FFD0"))),
        F.concat(F.lit("474946383961"), _hex(w, 2, False), _hex(h, 2, False)), F.concat(F.lit("424D" + "00" * 12 + "28000000"), _hex(w, 4, False), _hex(4294967296 - h, 4, False)),
        F.concat(F.lit("52494646000000005745425056503858" + "00" * 8), _hex(w - 1, 3, False), _hex(h - 1, 3, False)), F.concat(F.lit("000001000200" + "1010" + "00" * 14 + "0020"), F.lit("00" * 14)), two, loop,
        F.concat(F.lit("00000018667479706176696600000000"), F.lit("0000001469737065" + "00000000"), _hex(w, 4), _hex(h, 4)), jpeg(F.concat(F.lit("FFDA0002"), none)),
    ]
    made = F.lit(None).cast("string")
    for n, text in reversed(list(enumerate(formats))):  # only a part's own format is made
        made = F.when(k == n, text).otherwise(made)
    return dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.unhex(made).alias("content"))


def x13_picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = pictures.let(F.col("content"), pictures.picture_size)
    return _made(spark, sf_dir).withColumn("size", size).select("p_partkey", F.col("size.width").alias("width"), F.col("size.height").alias("height"))


def c9_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the pictures that are TIFFs; previews are none, and a chain that comes back is broken."""
    pages = pictures.let(F.col("content"), pictures.tiff_pages)
    return _made(spark, sf_dir).withColumn("pages", pages).select("p_partkey", F.when(F.col("pages").isNotNull(), F.size("pages")).alias("pages"), F.col("pages")[0]["height"].alias("height"))


QUERIES = {f.__name__: f for f in (x13_picture_sizes, c9_tiff_pages)}
ORACLE_SQL = {
    "x13_picture_sizes": """WITH p AS (SELECT p_partkey, 100 + CAST(p_size AS BIGINT) AS w, 1 + p_partkey % 10000 AS h, p_partkey % 12 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 2 THEN h WHEN k = 7 THEN 256 WHEN k = 8 AND p_partkey % 2 = 0 THEN NULL WHEN k IN (9, 11) THEN NULL ELSE w END AS width,
  CASE WHEN k = 2 THEN w WHEN k = 7 THEN 32 WHEN k = 8 AND p_partkey % 2 = 0 THEN NULL WHEN k IN (9, 11) THEN NULL ELSE h END AS height FROM p""",
    "c9_tiff_pages": "SELECT p_partkey, CASE WHEN p_partkey % 12 = 8 THEN CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 2 END END AS pages, CASE WHEN p_partkey % 12 = 8 THEN 1 + p_partkey % 10000 END AS height FROM part",
}
