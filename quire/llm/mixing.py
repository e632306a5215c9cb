"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A document's size is its number of words. Sources in code-point order (null last) take the weights in turn;
they share `share` times all sizes, no source beyond `most` times its own size, and what a full source leaves
goes to the others by weight. With sources ordered by the ratio at which they are full (most * size / weight),
the sources that end full are a prefix, so two running sums give everybody's target at once.

Every document of a source is expected target / source_size times. Within a source, documents stand from the
largest to the smallest; the prefix sum of the expected copies (rank times rate) plus one random offset of the
source decides: a document is emitted once for each integer that its step crosses. Expected copies of at most
`most` give at most `most` copies, and by that order the taken words of a source miss its target by less than its
largest document. The offset is a hash of the seed and the source, so reruns agree.

Ranks and running sums are those of a range-sorted table: rows are numbered inside blocks of the order, and the
sums of the blocks before (one row for each block and source) are added. So neither a hot source nor the list
of all sources meets in one task, and texts never move: they are read once, for their sizes.

Defined cases: null, empty and wordless texts have size 0 and are taken 0 words; a source of size 0 has target 0;
null is a source of its own, the last; rows of equal source, size and doc_id are numbered as they are read, which
changes no row of the result; repeated rows and doc_ids count each; null doc_ids are kept; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import stored, table

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
MOST = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def running(rows: DataFrame, order: list[Column], within: list[str], facts: DataFrame | None = None, **sums: str) -> DataFrame:
    """rows with the sums of long columns over the rows of the same `within` up to and with this one, in an order
    without ties. Blocks are the ranges of a sorted table; what a window sees is one block, or the list of blocks.
    facts, at most one row for each value of `within`, are joined to the blocks and so to all rows without meeting a hot value."""
    placed = stored(rows.repartitionByRange(*[F.col(c) for c in within], *order).withColumn("_block", F.spark_partition_id()))
    keys = ["_block", *within]
    before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*keys).agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    starts = blocks.select(*[F.col(c).alias(f"_of_{c}") for c in keys], *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    told = []
    if facts is not None:
        told = [c for c in facts.columns if c not in within]
        starts = starts.join(facts, all_of(F.col(f"_of_{c}").eqNullSafe(facts[c]) for c in within)).drop(*within)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select(*placed.columns, *[F.sum(v).over(inside).alias(f"_in_{k}") for k, v in sums.items()])
    joined = summed.join(starts, all_of(F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys))
    return joined.select(*rows.columns, *told, *[(F.col(f"_in_{k}") + F.col(f"_{k}")).alias(k) for k in sums])


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for sizes (source, source_size), one row a source; share is a fraction of whole numbers.

    The level of a source is what a unit of weight gets if exactly the sources before it, in the order in which they fill,
    are full. Levels rise while sources are full and fall from the first one that is not, so the highest level among
    sources that are not full is the one that holds for all. With a share above `most` all are full."""
    by_code_point = [F.col("source").isNull().cast("int"), F.col("source")]
    ranked = running(sizes.withColumn("one", F.lit(1).cast("long")), by_code_point, [], place="one")
    nth = ((F.col("place") - 1) % len(weights) + 1).cast("int")
    weighed = ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), nth).alias("weight"))
    weighed = weighed.withColumn("filled", most * F.col("source_size") / F.col("weight"))
    summed = running(weighed, [F.col("filled"), *by_code_point], [], sizes_to="source_size", weights_to="weight")
    total = weighed.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    up, down = share
    left = up * F.col("all_sizes") - down * most * (F.col("sizes_to") - F.col("source_size"))
    level = left.cast("double") / (down * (F.col("all_weights") - F.col("weights_to") + F.col("weight"))).cast("double")
    one_level = summed.join(F.broadcast(total), F.lit(True)).withColumn("level", level).where("level <= filled").agg(F.max("level").alias("level"))  # one row
    full = (most * F.col("source_size")).cast("double")
    return weighed.join(F.broadcast(one_level), F.lit(True)).select("source", "source_size", F.least(full, F.coalesce(F.col("weight") * F.col("level"), full)).alias("target"))


def offset_of(seed: str) -> Column:
    """The random offset of a source: a number from 0 to below 1 in steps of 2 ** -16."""
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 4), 16, 10).cast("double") / 65536


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each row of docs (doc_id, source, text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", "source", size.alias("size"))).withColumn("tie", F.monotonically_increasing_id())
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stored(targets(stored(sizes), weights, share, most))
    ranked = running(sized.withColumn("one", F.lit(1).cast("long")), [F.desc("size"), F.asc("doc_id"), F.asc("tie")], ["source"], facts=aims, rank="one")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(F.col("rank") * rate + offset_of(seed)) - F.floor((F.col("rank") - 1) * rate + offset_of(seed))
    return ranked.select("doc_id", "source", "size", "source_size", "target", crossed.alias("copies"))


def copies_of(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that share doc_id and size are told apart by their order among themselves."""
    ids = Window.partitionBy("_id", "_size")
    taken = mixture(docs, **settings).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    taken = taken.withColumn("_nth", F.row_number().over(ids.orderBy(F.desc("_copies")))).where("_copies > 0")
    sized = docs.withColumns({"_id": F.col("doc_id"), "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")})
    numbered = sized.withColumn("_nth", F.row_number().over(ids.orderBy("source", F.sha2("text", 256)))).alias("d")
    joined = numbered.join(taken.alias("t"), all_of(F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("_id", "_size", "_nth")))
    return joined.select("d.*", F.explode(F.sequence(F.lit(1).cast("long"), "t._copies"))).select(*docs.columns)


def op12_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixture(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op12_systematic": op12_systematic}
ORACLE_SQL = {
    "op12_systematic": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, 2 * source_size / weight AS filled,
  sum(source_size) OVER o - source_size AS sizes_before, sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left, sum(source_size) OVER () AS all_sizes
  FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, place)),
l AS (SELECT *, CAST(3 * all_sizes - 4 * sizes_before AS DOUBLE) / CAST(2 * weight_left AS DOUBLE) AS level FROM f),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT max(level) FROM l WHERE level <= filled)) AS target,
  CAST('0x' || md5('{SEED}:' || coalesce('=' || source, '-'))[1:4] AS INTEGER) / 65536 AS u FROM l),
r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) AS rank FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rank * rate + u) - floor((rank - 1) * rate + u)) AS BIGINT) AS taken FROM r""",
}
