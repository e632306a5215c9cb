"""Near duplicates among embeddings by p-stable hashing for Euclidean distance, and exact cosines within buckets.

A vector scaled to unit length is hashed in `tables` tables, each by `projections` quantised random
projections floor((a x + b) / width) with Gaussian a, which are 2-stable: the chance of a collision depends on
the distance only. At cosine 0.93 (distance 0.374) a pair meets in at least one of the 16 tables of 8
projections of width 2 with a probability of 0.994, at 0.96 of 0.9997; tests measure the recall against brute force.

Equal vectors of a label are one representative with a multiplicity. A bucket is compared in blocks of
`block` rows, so that its pairs spread over tasks; pairs are never rows: a block gives each vector its number
of links and a spanning link, and a pair that meets in several tables counts in the first of them only.
Cosines are computed in double precision from the original components.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor does
one with a null label or a null vec_id (its component_id is its vec_id); vectors of different length never
link; a pair whose cosine is the bound itself, as computed, links; repeated rows are vectors of their own that link with each other; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import connected_components, cut, in_slices, mixed, stored, table

COSINE = 0.93


@dataclass(frozen=True)
class Hashing:
    tables: int = 16
    projections: int = 8
    width: float = 2.0
    seed: int = 20240601

    def signatures(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) bucket numbers of unit vectors."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        a = rng.normal(size=(unit.shape[1], self.tables * self.projections))
        b = rng.uniform(0, self.width, self.tables * self.projections)
        h = np.floor((unit @ a + b) / self.width).astype(np.int64).astype(np.uint64).reshape(len(unit), self.tables, self.projections)
        out = np.zeros(h.shape[:2], np.uint64) + mixed(np.arange(1, self.tables + 1, dtype=np.uint64))
        for k in range(self.projections):
            out = mixed(out + h[:, :, k])
        return out.view(np.int64)


def _usable(vector: list | None) -> np.ndarray | None:
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64) + 0.0
    return x if np.isfinite(x).all() and (x != 0).any() and np.isfinite(x @ x) and x @ x > 0 else None


def hashed(vectors: DataFrame, hashing: Hashing) -> DataFrame:
    """vec_id, label (as text), digest of the components, the components, and the bucket of each table; usable vectors only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("digest", pa.binary()), ("x", pa.list_(pa.float64())), ("buckets", pa.list_(pa.int64()))])
        for batch in in_slices(batches, 2048):
            rows = [(i, y, x) for i, y, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) if (x := _usable(v)) is not None]
            by_length: dict[int, list[int]] = {}
            for k, r in enumerate(rows):
                by_length.setdefault(len(r[2]), []).append(k)
            buckets: dict[int, np.ndarray] = {}
            for members in by_length.values():
                x = np.stack([rows[k][2] for k in members])
                buckets.update(zip(members, hashing.signatures(x / np.linalg.norm(x, axis=1, keepdims=True)), strict=True))
            columns = ([r[0] for r in rows], [r[1] for r in rows], [xxhash.xxh3_128_digest(r[2].tobytes()) for r in rows], [r[2] for r in rows], [buckets[k] for k in range(len(rows))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return vectors.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, label string, digest binary, x array<double>, buckets array<long>")


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in each row's component of a symmetric link matrix."""
    roots, last = ids.copy(), None
    far = np.iinfo(np.int64).max
    while last is None or (roots != last).any():
        last = roots
        near = np.where(linked, roots[None, :], far).min(axis=1)
        roots = np.minimum(roots, near)
    return roots


def _linked(cosine: float):
    """Walks rows sorted by block and gives (vec_id, links, root) for what each block links."""

    def block(rows: list[tuple]) -> list[tuple[int, int, int]]:
        t = rows[0][0]
        ids = np.array([r[1] for r in rows])
        copies = np.array([r[2] for r in rows])
        left, right = (np.array([r[3] for r in rows]) <= 0), (np.array([r[3] for r in rows]) >= 0)
        buckets = np.array([r[4] for r in rows])
        x = np.stack([r[5] for r in rows])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        ok = x @ x.T >= cosine
        if left.all() and right.all():
            np.fill_diagonal(ok, False)
        else:
            ok &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
        for earlier in range(t):
            if not ok.any():
                return []
            ok &= buckets[:, earlier][:, None] != buckets[:, earlier][None, :]
        some = np.flatnonzero(ok.any(axis=1))
        if not len(some):
            return []
        ok = ok[np.ix_(some, some)]
        return list(zip(ids[some].tolist(), (ok @ copies[some]).tolist(), _roots(ok, ids[some]).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["vec_id", "links", "root"])

        key, rows, found = None, [], []
        for batch in in_slices(batches, 512):
            columns = [batch.column(k).to_pylist() for k in range(9)]
            x = batch.column(9)
            for k, own in enumerate(zip(*columns[:5], strict=True)):
                if own != key:
                    if len(rows) > 1:
                        found += block(rows)
                    key, rows = own, []
                    if len(found) > 50_000:
                        yield out(found)
                        found = []
                rows.append((columns[4][k], columns[5][k], columns[6][k], columns[7][k], columns[8][k], x[k].values.to_numpy(zero_copy_only=False)))
        if len(rows) > 1:
            found += block(rows)
        yield out(found)

    return run


def classes(vectors: DataFrame, *, cosine: float = COSINE, hashing: Hashing | None = None, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    hashing = hashing or Hashing()
    known = stored(hashed(vectors, hashing))
    firsts = known.groupBy("label", "digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    member = known.select("vec_id", "label", "digest").join(firsts, ["label", "digest"]).select("vec_id", "first", "copies")
    member = cut(member)
    one = known.groupBy("label", "digest").agg(F.min_by(F.struct("x", "buckets"), "vec_id").alias("v"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    one = one.select("vec_id", "copies", F.xxhash64("label", F.size("v.x")).alias("kind"), "v.x", "v.buckets")
    each = one.select("*", F.posexplode("buckets").alias("t", "bucket"))
    sizes = each.groupBy("kind", "t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    dealt = each.join(sizes, ["kind", "t", "bucket"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    # the rows of part p meet those of every part q: the lower part is the left side, and one part alone is both
    blocks = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).select(
        F.xxhash64("kind", "t", "bucket").alias("key"), "kind", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "t", "vec_id", "copies", F.signum(F.col("part") - F.col("q")).cast("int").alias("side"), "buckets", "x"
    )
    ordered = blocks.repartition("key", "kind", "i", "j", "t").sortWithinPartitions("key", "kind", "i", "j", "t")
    links = ordered.mapInArrow(_linked(cosine), "vec_id long, links long, root long")
    found = cut(links.groupBy("vec_id", "root").agg(F.sum("links").alias("links")))
    counts = found.groupBy(F.col("vec_id").alias("first")).agg(F.sum("links").alias("n"))
    components = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "first")
    result = member.join(counts, "first", "left").join(components, "first", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    alone = every.join(member.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_p_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_p_stable": op2_p_stable}
ORACLE_SQL = {
    "op2_p_stable": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(d, r) AS (SELECT x, y FROM link UNION SELECT reach.d, link.y FROM reach JOIN link ON reach.r = link.x)
SELECT v.vec_id, coalesce(c, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, least(v.vec_id, coalesce(m, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT x AS vec_id, count(*) AS c FROM link GROUP BY x) USING (vec_id) LEFT JOIN (SELECT d AS vec_id, min(r) AS m FROM reach GROUP BY d) USING (vec_id)""",
}
