"""Merkle dataset manifest: a hash tree over each source's documents, one over the sources, and a proof for every row.

H is the SHA-256 of its inputs joined, digests as lower-case hex. A node covers `ARITY` consecutive nodes of the level
below (the last run may be shorter, even one), so node i of level k covers the leaves from i * ARITY ** k, and every node
has a coordinate (tree, level, index) that is known before anything above it exists.

1. Leaves are hashed where the documents are read; from here on only keys and digests move.
2. Leaves are range-sorted by (tree, doc_id). A partition holds one run of leaves of each of its trees, a block. Blocks
   are counted, and the counts before a block are its offset: the first coordinate of its leaves.
3. Each block builds every subtree that lies wholly inside it. The nodes that are left over at its ragged ends, some
   2 * (ARITY - 1) a level, are stored.
4. Those are shuffled by the coordinate of an ancestor: in rounds, all nodes under one node of a high level meet, build
   that node, and learn their way (the siblings) up to it. A round takes at most ARITY ** step leaves' or nodes' span, so
   no task sees more, whatever the size of a source.
5. The roots of the trees are the leaves of the tree over the sources, built by the same steps.
6. Each block meets the ways of its left-over nodes again and writes a row for each leaf with the siblings' hash. The
   tampered leaf, else the original one, is folded with the siblings; the row is verified if that gives the root.

The largest groups are a block, some `BLOCK_ROWS` leaves (about 300 bytes each in a worker), and a round's span. Texts are read once.

Defined cases: null values are hashed as `-`, so null and empty differ; null sources are a tree of their own, the first;
null doc_ids come first; rows of one source and doc_id stand in the order of their leaves, and equal rows, whose leaves are
equal, take neighbouring places; one document is its source's subroot, and one source's subroot is the root; a proof
without siblings is the hash of nothing; very long texts are hashed where they are read; extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import stored, table

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a block: about as many at most, and not fewer for the sake of more tasks.
BLOCK_ROWS, FEW_ROWS = 200_000, 20_000
#: Levels that a round of step 4 climbs: the first from leaves and what blocks built, the others from whole levels.
FIRST_STEP, STEP = 14, 8


def field_hash(values: list[Column]) -> Column:
    """The digest (binary) of a row's values."""
    text = [c.cast("string") for c in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """Rows (tree, name, doc_id, leaf, tampered) of documents. tree orders as the sources do, null first. tampered is null where nothing is tampered with."""
    cut = field_hash([F.col(c) if c != "text" else F.replace("text", F.lit("\n"), F.lit("")) for c in FIELDS])
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), F.lit(None).cast("string").alias("name"), F.col("doc_id").cast("long").alias("doc_id"),
        field_hash([F.col(c) for c in FIELDS]).alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, cut).alias("tampered"),
    )


def node(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def width(n: int, level: int) -> int:
    """How many nodes a tree of n leaves has at a level."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


class Span:
    """What can be built of one tree from some of its nodes: levels of {index: digest}, up to level `top`."""

    def __init__(self, n: int, top: int, given: dict[int, dict[int, bytes]]):
        self.n, self.top = n, min(top, height(n))
        self.levels = [dict(given.get(k, {})) for k in range(self.top + 1)]
        self.left = []
        for k in range(self.top):
            here, above, size = self.levels[k], self.levels[k + 1], width(n, k)
            for i in sorted({i // ARITY for i in here}):
                run = [here.get(j) for j in range(i * ARITY, min(size, i * ARITY + ARITY))]
                if None in run:
                    self.left += [(k, i * ARITY + j, d) for j, d in enumerate(run) if d is not None]
                else:
                    above[i] = node(run)
        self.left += [(self.top, i, d) for i, d in self.levels[self.top].items()]

    def way(self, level: int, index: int) -> tuple[bytes, int, int]:
        """The siblings from a node to the highest node above it here, as one byte of place and size for each level and the
        siblings' digests, and that node's coordinate."""
        parts = []
        while level < self.top and index // ARITY in self.levels[level + 1]:
            first = index - index % ARITY
            run = range(first, min(width(self.n, level), first + ARITY))
            parts.append(bytes([(index - first) * 16 + len(run)]))
            parts += [self.levels[level][j] for j in run if j != index]
            level, index = level + 1, index // ARITY
        return b"".join(parts), level, index


def steps_of(way: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The siblings left and right of the way, level by level."""
    at = 0
    while at < len(way):
        place, size = divmod(way[at], 16)
        digests = [way[at + 1 + 32 * j : at + 33 + 32 * j] for j in range(size - 1)]
        yield digests[:place], digests[place:]
        at += 1 + 32 * (size - 1)


def folded(leaf: bytes, way: bytes) -> bytes:
    for before, after in steps_of(way):
        leaf = node([*before, leaf, *after])
    return leaf


def proof(way: bytes) -> bytes:
    return node([d for before, after in steps_of(way) for d in (*before, *after)])


ORDER = ("name", "doc_id", "leaf", "tampered")
COORDINATES = "tree string, block int, n long, level int, index long"


def in_order(block: pa.Table) -> pa.Table:
    return block.take(pc.sort_indices(block, sort_keys=[(c, "ascending") for c in ORDER], null_placement="at_start"))


def span_of(block: pa.Table, top: int) -> Span:
    """The subtrees, up to a level, that lie wholly in a block, whose leaves are in order."""
    return Span(block["n"][0].as_py(), top, {0: dict(enumerate(block["leaf"].to_pylist(), block["offset"][0].as_py()))})


def placed(rows: DataFrame, block_rows: int = BLOCK_ROWS, few_rows: int = FEW_ROWS) -> DataFrame:
    """Rows like those of leaves() with their block (int), its offset in the tree and the tree's number of leaves, n."""
    rows = stored(rows)
    n = rows.count()
    tasks = max(1 + n // block_rows, min(1 + n // few_rows, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(tasks, "tree", *ORDER, "tie")
    blocks = stored(ordered.select("tree", *ORDER, F.spark_partition_id().alias("block")))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy("tree", "block").agg(F.count("*").alias("rows"))
    starts = counts.select("tree", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(tree).alias("n"))
    return blocks.join(starts, ["tree", "block"])


def climbed(nodes: DataFrame, top: int) -> DataFrame:
    """One round: each node (tree, n, level, index, digest) with its way to the node of level `top` above it, or to the root
    of its tree if that is lower, and with that node's coordinate and digest."""

    def climb(group: pa.Table) -> pa.Table:
        given = {}
        coordinates = list(zip(group["level"].to_pylist(), group["index"].to_pylist(), strict=True))
        for (k, i), d in zip(coordinates, group["digest"].to_pylist(), strict=True):
            given.setdefault(k, {})[i] = d
        span = Span(group["n"][0].as_py(), top, given)
        ways = [span.way(k, i) for k, i in coordinates]
        group = group.drop_columns(["span"]).append_column("way", pa.array([w for w, _, _ in ways], pa.binary()))
        group = group.append_column("above_level", pa.array([k for _, k, _ in ways], pa.int32())).append_column("above", pa.array([i for _, _, i in ways], pa.int64()))
        return group.append_column("above_digest", pa.array([span.levels[k][i] for _, k, i in ways], pa.binary()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    widths = ", ".join(f"{ARITY ** (top - k)}L" for k in range(top + 1))
    spans = nodes.withColumn("span", F.expr(f"index div element_at(array({widths}), level + 1)"))
    return stored(spans.groupBy("tree", "span").applyInArrow(climb, f"{schema}, way binary, above_level int, above long, above_digest binary"))


def ways_up(blocks: DataFrame, first_step: int = FIRST_STEP, step: int = STEP) -> DataFrame:
    """Of placed() leaves: (tree, block, level, index, way, subroot) of every node that has no parent inside its block."""

    def left_over(block: pa.Table) -> pa.Table:
        tree, number, n = (block[c][0].as_py() for c in ("tree", "block", "n"))
        rows = span_of(in_order(block), first_step).left
        columns = ([tree] * len(rows), [number] * len(rows), [n] * len(rows), *zip(*rows, strict=True))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names="tree block n level index digest".split())

    nodes = stored(blocks.groupBy("tree", "block").applyInArrow(left_over, f"{COORDINATES}, digest binary"))
    most = nodes.agg(F.max("n")).first()[0] or 1
    ways, top = climbed(nodes, first_step), first_step
    while top < height(most):
        top += step
        tops = ways.groupBy("tree", "above_level", "above").agg(F.first("n").alias("n"), F.first("above_digest").alias("digest"))
        upper = climbed(tops.select("tree", "n", F.col("above_level").alias("level"), F.col("above").alias("index"), "digest"), top)
        upper = upper.select("tree", F.col("level").alias("above_level"), F.col("index").alias("above"), F.col("way").alias("on"), F.struct("above_level", "above", "above_digest").alias("to"))
        ways = ways.join(upper, ["tree", "above_level", "above"]).select("tree", "block", "n", "level", "index", F.concat("way", "on").alias("way"), "to.*")
    return ways.select("tree", "block", "level", "index", "way", F.col("above_digest").alias("subroot"))


def each_leaf(block: pa.Table, ways: pa.Table, top: int) -> Iterator[tuple[bytes, dict]]:
    """For the leaves of a block in order: the way to its root, and the row of ways that leads there."""
    span, first = span_of(block, top), block["offset"][0].as_py()
    known = {(r["level"], r["index"]): r for r in ways.to_pylist()}
    for row in range(block.num_rows):
        way, level, index = span.way(0, first + row)
        yield way + known[level, index]["way"], known[level, index]


def sources_up(trees: DataFrame, **steps: int) -> DataFrame:
    """(tree, on, root) for (tree, subroot), a row a tree: the way from its subroot to the root over all trees, in the order of their names."""

    def emit(key: tuple, block: pa.Table, ways: pa.Table) -> pa.Table:
        block = in_order(block)
        found = list(each_leaf(block, ways, steps.get("first_step", FIRST_STEP)))
        return pa.table({"tree": block["name"], "on": pa.array([w for w, _ in found], pa.binary()), "root": pa.array([r["subroot"] for _, r in found], pa.binary())})

    rows = trees.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.lit(None).cast("long").alias("doc_id"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("tampered"))
    blocks = placed(rows)
    pair = blocks.groupBy("tree", "block").cogroup(ways_up(blocks, **steps).groupBy("tree", "block"))
    return pair.applyInArrow(emit, "tree string, on binary, root binary")


OUT = ("leaf", "subroot", "root", "proof_sha256", "folded_root")


def manifest(docs: DataFrame, *, block_rows: int = BLOCK_ROWS, few_rows: int = FEW_ROWS, **steps: int) -> DataFrame:
    """(tree, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof): a row for each document, proof being its way."""

    def emit(key: tuple, block: pa.Table, ways: pa.Table) -> pa.Table:
        block, out, proofs = in_order(block), {c: [] for c in OUT}, []
        for leaf, tampered, (way, to) in zip(block["leaf"].to_pylist(), block["tampered"].to_pylist(), each_leaf(block, ways, steps.get("first_step", FIRST_STEP)), strict=True):
            way += to["on"]
            digests = (leaf, to["subroot"], to["root"], proof(way), folded(tampered or leaf, way))
            for c, d in zip(OUT, digests, strict=True):
                out[c].append(d.hex())
            proofs.append(way)
        verified = [a == b for a, b in zip(out["folded_root"], out["root"], strict=True)]
        return pa.table({"tree": block["tree"], "doc_id": block["doc_id"]} | {c: pa.array(v, pa.string()) for c, v in out.items()} | {"verified": pa.array(verified, pa.bool_()), "proof": pa.array(proofs, pa.binary())})

    blocks = placed(leaves(docs), block_rows, few_rows)
    ways = stored(ways_up(blocks, **steps))
    top = stored(sources_up(ways.groupBy("tree").agg(F.first("subroot").alias("subroot")), **steps))
    pair = blocks.groupBy("tree", "block").cogroup(ways.join(top, "tree").groupBy("tree", "block"))
    return pair.applyInArrow(emit, f"tree string, doc_id long, {', '.join(f'{c} string' for c in OUT)}, verified boolean, proof binary")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).select("doc_id", *OUT, "verified")


#: crc32 of an ASCII text in DuckDB, which has shifts and xor but no checksum.
CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _hashed(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _walk(name: str, start: str, nodes: str) -> str:
    """A recursive table that goes up from rows (r, s, i, n, h, sib) through nodes (s, k, i, h), folding h and gathering siblings."""
    return f"""{name} AS ({start} UNION ALL
  SELECT r, w.s, w.k + 1, w.i // 3, (w.n + 2) // 3, sha256(coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < w.i), '') || w.h || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > w.i), '')),
    w.sib || coalesce(string_agg(u.h, '' ORDER BY u.i), '')
  FROM {name} w LEFT JOIN {nodes} u ON u.s IS NOT DISTINCT FROM w.s AND u.k = w.k AND u.i // 3 = w.i // 3 AND u.i <> w.i WHERE w.n > 1 GROUP BY r, w.s, w.k, w.i, w.n, w.h, w.sib)"""


_UP = "SELECT s, k + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)"

QUERIES = {"op13_merkle": op13_merkle}
ORACLE_SQL = {
    "op13_merkle": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source AS s, {_hashed("text")} AS leaf,
  CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_hashed("replace(text, chr(10), '')")} ELSE {_hashed("text")} END AS given FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
u AS (SELECT s, 0 AS k, i, leaf AS h, n FROM l UNION ALL {_UP} FROM u WHERE n > 1 GROUP BY s, k, i // 3),
roots AS (SELECT s, h AS subroot, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM u WHERE n = 1),
v AS (SELECT NULL AS s, 0 AS k, i, subroot AS h, n FROM roots UNION ALL {_UP} FROM v WHERE n > 1 GROUP BY s, k, i // 3),
{_walk("a", "SELECT r, s, 0 AS k, i, n, given AS h, '' AS sib FROM l", "u")},
{_walk("b", "SELECT r, NULL AS s, 0 AS k, roots.i, roots.n, h, sib FROM a JOIN roots ON a.s IS NOT DISTINCT FROM roots.s WHERE a.n = 1", "v")}
SELECT doc_id, leaf, subroot, (SELECT h FROM v WHERE n = 1) AS root, sha256(b.sib) AS proof_sha256, b.h AS folded_root, b.h = (SELECT h FROM v WHERE n = 1) AS verified
FROM b JOIN l USING (r) JOIN roots ON l.s IS NOT DISTINCT FROM roots.s WHERE b.n = 1""",
}
