"""Running sums and minima over an order that no task holds whole: a table is sorted by range, and what stands before a range is added to it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.stored import stored


#: The least number of parts over which dealt() spreads rows.
LEAST_PARTS = 200


def dealt(rows: DataFrame, *keys: Column | str, parts: int = LEAST_PARTS) -> DataFrame:
    """rows with equal keys in one task, and few in each: as many tasks as shuffles have, `parts` at least, which are not put together again as small ones are."""
    return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def running(rows: DataFrame, order: list[Column], within: list[str], *, sums: dict[str, str] | None = None, minima: dict[str, str] | None = None) -> DataFrame:
    """rows with the running sums and minima of columns, each row with itself, among the rows of the same `within`, in an order without ties.

    A window sees the rows of one range, or the list of ranges (one row for each range and value of `within`), so neither a
    hot value nor a single long table meets in one task. Nulls add nothing."""
    wanted = {k: (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), c) for k, c in (sums or {}).items()} | {k: (F.min, F.least, c) for k, c in (minima or {}).items()}
    placed = stored(rows.repartitionByRange(*[F.col(c) for c in within], *order).withColumn("_block", F.spark_partition_id()))
    keys = ["_block", *within]
    earlier = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*keys).agg(*[of(c).alias(f"_{k}") for k, (of, _, c) in wanted.items()])
    before = blocks.select(*[F.col(c).alias(f"_of_{c}") for c in keys], *[of(f"_{k}").over(earlier).alias(f"_{k}") for k, (of, _, _) in wanted.items()])
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select(*placed.columns, *[of(c).over(here).alias(f"_in_{k}") for k, (of, _, c) in wanted.items()])
    joined = inside.join(before, all_of(F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys))
    return joined.select(*rows.columns, *[both(F.col(f"_in_{k}"), F.col(f"_{k}")).alias(k) for k, (_, both, _) in wanted.items()])
