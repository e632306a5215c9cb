"""N-gram Jaccard join by PartEnum signatures, and the classes of near duplicates that it links.

A document's set is its distinct five-word shingles (hashed to 64 bits). Sets fall into bands of sizes [l, GROWTH * l].
Two sets of one band, or a set and one at the foot of the next band, with Jaccard similarity of at least
0.8 differ in at most k = 2r/9 elements, r the band's largest size.

Signatures, on two levels. The feature domain is partitioned by hash into n + e groups, n = ceil((k + 1) / 2): at least
1 + e groups of such sets differ in one element at most. Each group is partitioned again into three parts, and every subset of
two parts makes a signature; where a group differs in one element, one of its three subsets agrees. An empty subset
makes no signature, as too many sets share it. A group with one is bad; a set of at most e bad groups still shares a
subset that is not empty with every similar set. A set of more also makes the signatures of the next seed, and so does
every similar set whose agreeing subsets are all empty, since it has the same bad groups.

Linear candidates. Equal sets are one class from the start. Signatures are combined where they are made, so a
frequent one reaches a task as one row for each combined batch. Each document is compared, on the texts, with
one centre, the smallest document that it shares a signature with in a batch or as first of its batch: a
star, not all pairs. Where documents of one signature are in different classes after that, they are compared
across classes, clusters of them in blocks: pairs are never rows, a block gives the links that join its classes, and
an exact bound (parities of hash buckets) spares most intersections. Similar sets share a known number of signatures;
documents that share fewer with all others (a passage in common, say) are in no similar pair and fall out before. So the result
is whole: every similar pair shares a signature, and is compared or already in one class.

Defined cases: no words (null or empty text): n_shingles 0, linked with nothing; fewer than five words: one
shingle of all; repeated rows are equal sets; a null doc_id is kept and links nothing; empty tables
give no rows; extra columns are ignored; very long texts are hashed in pieces. Any number of documents may share a set, a
signature or a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import MIX_B, binary, connected_components, cut, in_slices, mixed, released, rolled, stored, table, word_hashes

WIDTH, GROWTH = 5, 1.4
#: Documents, and shingles, of a block that is compared in one task.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: A table of ids of so many rows (some 16 MB) is small enough to broadcast.
BROADCAST_ROWS = 500_000
#: The centre of a signature that no other document of its batch has.
ALONE = -(2**63)
#: Signatures that a task combines at a time, and that a task of the shuffle gets.
MOST, A_TASK = 500_000, 1_500_000
#: The last seed makes signatures of empty subsets too.
SEEDS = 8


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for h in word_hashes([(t or b"").lower() for t in texts]):
        n = len(h)
        yield np.unique(rolled(h, width)) if n >= width else rolled(h, n, MIX_B + np.uint64(2 * n)) if n else np.zeros(0, np.uint64)


def shingles_of(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    return next(shingle_sets([text], width))


def bands(largest: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * GROWTH))
        out.append((low, high))
        low = high + 1
    return out


BANDS = bands(1 << 40)
_FEET = np.array([low for low, _ in BANDS])


def _seeds(groups: int, spare: int, n: float) -> float:
    """Seeds that a set of n elements uses on average: one more whenever more than `spare` groups are bad."""
    mean = groups * min(1.0, 3 * math.exp(-2 * n / (3 * groups)) - 2 * math.exp(-n / groups))
    if mean > 50:
        more = 0.5 * math.erfc((spare + 0.5 - mean) / math.sqrt(2 * mean))
    else:
        more = 1 - math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(min(spare, 120) + 1))
    return 1 / (1 - min(1 - 1 / SEEDS, max(0.0, more)))


@lru_cache(maxsize=None)
def parameters(band: int) -> tuple[int, int, int]:
    """Groups, how many of them may be bad (spare), and the most elements in which similar sets of the band differ. No groups where they cannot differ.

    More spare groups make more signatures with each seed, fewer make more seeds: the least of both over the sizes that use the band.
    """
    low, high = BANDS[band]
    k = 2 * high // 9
    if k == 0:
        return 0, 0, 0
    n = (k + 2) // 2
    sizes = [0.8 * low, 0.9 * low, low, (low + high) / 2, high]
    spare = min({0, 1, 2, 3, *(n * x // 100 for x in range(0, 120, 2))}, key=lambda e: ((n + e) * sum(_seeds(n + e, e, size) for size in sizes), e))
    return n + spare, spare, k


def bands_of(n: int) -> list[int]:
    """The bands in which a set of n elements makes signatures: its own, and the next one if it is large enough to meet that band's sets."""
    own = int(np.searchsorted(_FEET, n, "right")) - 1
    return [b for b in (own, own + 1) if parameters(b)[0] and (b == own or 5 * n >= 4 * BANDS[b][0])]


def signatures(shingles: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each band of a set: its signatures (the last seven bits tell the band), and how many of them it shares with any similar set, at least."""
    out, weights = [], mixed(shingles + MIX_B)
    for band in bands_of(len(shingles)):
        groups, spare, k = parameters(band)
        found = []
        for seed in range(SEEDS):
            tag = np.uint64(band + 1 + (seed << 40))
            place = (mixed(shingles ^ tag) % np.uint64(3 * groups)).astype(np.uint16 if 3 * groups < 1 << 16 else np.int64)
            order = np.argsort(place, kind="stable")
            placed = place[order]
            first = np.flatnonzero(np.append(True, placed[1:] != placed[:-1]))
            held, some = np.zeros(3 * groups, np.uint64), np.zeros(3 * groups, bool)
            held[placed[first]] = np.add.reduceat(weights[order], first)
            some[placed[first]] = True
            held = mixed(held + mixed(np.arange(3 * groups, dtype=np.uint64) + (tag << np.uint64(8)))).reshape(-1, 3)
            some = some.reshape(-1, 3)
            made = mixed(held[:, [0, 0, 1]] * np.uint64(3) + held[:, [1, 2, 2]])
            filled = some[:, [0, 0, 1]] | some[:, [1, 2, 2]]
            bad = int((~filled).any(axis=1).sum())
            found.append(made[filled] if bad <= spare or seed < SEEDS - 1 else made.ravel())
            if bad <= spare:
                break
        # of a group without difference all three subsets agree, with one difference one does
        agreeing = 3 * groups - (2 * k if k <= groups else groups + k)
        need = max(1, agreeing - int((~filled).sum())) if seed == 0 else 1
        out.append(((np.concatenate(found) & ~np.uint64(127)) | np.uint64(band & 127), need))
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, and about how many signatures it makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = list(shingle_sets(binary(batch.column(1))))
            made = [sum(3 * parameters(b)[0] for b in bands_of(len(s))) if len(s) else 0 for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(made, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "n_signatures"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, n_shingles long, digest binary, n_signatures long")


def _combined(rows: list[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
    """Signatures of some documents, combined: a signature's smallest document is its local centre, the others are members."""
    sizes = [len(r[1]) for r in rows]
    doc, need = (np.repeat(np.array([r[k] for r in rows], kind), sizes) for k, kind in ((0, np.int64), (2, np.int32)))
    signature = np.concatenate([r[1] for r in rows]).view(np.int64)
    order = np.lexsort((doc, signature))
    doc, signature, need = doc[order], signature[order], need[order]
    new = np.append(True, signature[1:] != signature[:-1])
    centre = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    member = ~new
    shared = np.append(member[1:], False) & new
    by_doc = np.argsort(doc, kind="stable")  # rows of one document together compress well
    told = np.where(member | shared, doc[centre], ALONE)
    return pa.RecordBatch.from_arrays([pa.array(x[by_doc]) for x in (signature, doc, told, need)], names=["signature", "doc_id", "centre", "need"])


def occurrences(docs: DataFrame, most: int) -> DataFrame:
    """The signatures of all sets that are not empty, combined over about `most` of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen, held = [], {}, 0
        for batch in in_slices(batches, 256, 1 << 20):
            for key, s in zip(batch.column(0).to_pylist(), shingle_sets(binary(batch.column(1))), strict=True):
                if not len(s):
                    continue
                places = seen.setdefault(xxhash.xxh3_128_digest(s.tobytes()), [])
                for k in places:  # equal sets are one class already: the smallest document of the batch stands for them
                    rows[k] = (min(key, rows[k][0]), *rows[k][1:])
                if places:
                    continue
                for made, need in signatures(s):
                    places.append(len(rows))
                    rows.append((key, made, need))
                    held += len(made)
            if held > most:
                yield _combined(rows)
                rows, seen, held = [], {}, 0
        if held:
            yield _combined(rows)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "signature long, doc_id long, centre long, need int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of one shuffle partition: those of signatures that several documents have, with the smallest one as centre."""
    names = ["signature", "doc_id", "centre", "need"]
    parts = []
    for b in batches:
        signature, doc, centre, need = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        member = (centre != doc) & (centre != ALONE)
        if member.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[member]) for x in (signature, doc, centre, need)], names=names)
        parts.append((signature[~member], doc[~member], (centre == doc)[~member], need[~member]))
    if not parts:
        return
    signature, doc, shared, need = (np.concatenate(p) for p in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((doc, signature))
    signature, doc, shared, need = signature[order], doc[order], shared[order], need[order]
    same = np.append(False, signature[1:] == signature[:-1])
    first = doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))]
    keep = np.flatnonzero(same | np.append(same[1:], False) | shared)
    for at in range(0, len(keep), 1 << 16):
        k = keep[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (signature, doc, first, need)], names=names)


def shared_signatures(docs: DataFrame, most: int, n_signatures: int) -> DataFrame:
    """(signature, doc_id, centre, need) for every signature that at least two documents have; one exchange.

    Local centres are dealt by their signature; members, which know their local centre, by both: so a signature
    of any number of documents reaches one task only as one row for each combined batch. There are as many tasks as keep a task's rows at A_TASK.
    """
    local = (F.col("centre") == ALONE) | (F.col("centre") == F.col("doc_id"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n_signatures // A_TASK)
    dealt = occurrences(docs, most).repartition(tasks, F.when(local, F.xxhash64("signature")).otherwise(F.xxhash64("signature", "centre")))
    return dealt.mapInArrow(released(_shared), "signature long, doc_id long, centre long, need int")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in which the sets of text_a and text_b have a Jaccard similarity of at least 0.8."""
    last, centre = None, None
    for batch in in_slices(batches, 128):
        keep = []
        for b, s, tb in zip(batch.column(1).to_pylist(), shingle_sets(binary(batch.column(2))), binary(batch.column(3)), strict=True):
            if b != last:
                last, centre = b, shingles_of(tb)
            both = len(np.intersect1d(s, centre, assume_unique=True))
            keep.append(100 * both >= 80 * (len(s) + len(centre) - both) > 0)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids that are similar, judged on whole texts."""
    with_a = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = with_a.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(released(_compared), "a long, b long")


def _with_class(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(signature, doc_id, component) of the signatures whose documents are in more than one class."""
    known = shared.join(classes.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("signature", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = known.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("signature")
    return known.join(split, "signature")


def _blocks_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by block: links (a, b) that join all classes of a block between which two sets are similar."""
    key, rows, out = None, [], []
    for batch in in_slices(batches, 256):
        columns = [batch.column(k).to_pylist() for k in range(6)]
        texts = binary(batch.column(6))
        for k, own in enumerate(zip(*columns[:3], strict=True)):
            if own != key:
                out += _linked_classes(rows)
                key, rows = own, []
            rows.append((columns[3][k], columns[4][k], columns[5][k], texts[k]))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
            out = []
    out += _linked_classes(rows)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], names=["a", "b"])


def _linked_classes(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """rows: side (0: both, -1 and 1 meet each other), doc_id, class, text.

    Sets differ in at least as many elements as the parities of their hash buckets do; only pairs that sizes and parities
    allow, the likeliest first, are intersected, and none whose classes are joined already.
    """
    if len({r[2] for r in rows}) < 2:
        return []
    side, ids, of = (np.array([r[k] for r in rows]) for k in range(3))
    sets = list(shingle_sets([r[3] for r in rows]))
    sizes = np.array([len(s) for s in sets])
    bits = 64
    while bits < 8 * sizes.max():
        bits *= 2
    parities = np.stack([np.packbits(np.bincount((mixed(s ^ MIX_B) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64) for s in sets])
    likely, where = [], []
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        j = j[(of[j] != of[i]) & ((side[j] != side[i]) | (side[i] == 0)) & (9 * np.abs(sizes[j] - sizes[i]) <= sizes[j] + sizes[i])]
        if len(j):
            differ = np.bitwise_count(parities[j] ^ parities[i]).sum(axis=1, dtype=np.int64)
            ok = 9 * differ <= sizes[j] + sizes[i]
            likely.append(differ[ok] / (sizes[j] + sizes[i])[ok])
            where.append(np.stack([np.full(ok.sum(), i), j[ok]], axis=1))
    if not where:
        return []
    pairs = np.concatenate(where)[np.argsort(np.concatenate(likely), kind="stable")]
    root = {c: c for c in of.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in pairs.tolist():
        a, b = find(int(of[i])), find(int(of[j]))
        if a != b:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _across(split: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the classes of documents that share signatures across classes.

    Documents chained by such signatures of one band are one cluster; its documents are compared block by
    block, each pair of blocks in a task of its own if need be. A block is bounded by documents and by their shingles.
    """
    split = split.withColumn("member", F.xxhash64("doc_id", F.col("signature").bitwiseAND(F.lit(127))))
    first = split.groupBy("signature").agg(F.min("member").alias("b"))
    chained = connected_components(split.join(first, "signature").select(F.col("member").alias("a"), "b").distinct()).withColumnsRenamed({"node": "member", "component": "cluster"})
    members = split.select("member", "doc_id", "component").distinct().join(chained, "member").join(texts, "doc_id")
    size = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = members.join(size, "cluster")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cluster", "i", "j"]
    dealt = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.signum(F.col("block") - F.col("other")).cast("int").alias("side"), "doc_id", "component", "text")
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(_blocks_linked), "a long, b long")


def _small(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for a broadcast if it has at most BROADCAST_ROWS rows; Spark chooses otherwise."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def classes(docs: DataFrame, *, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; see the module's text."""
    about = stored(described(docs))
    sets = about.where("doc_id is not null and n_shingles > 0")
    firsts = sets.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("first"))
    copies = sets.select("doc_id", "n_shingles", "digest").join(firsts, ["n_shingles", "digest"]).where("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    copies = cut(copies)
    band = F.col("signature").bitwiseAND(F.lit(127)).cast("int")
    total = sets.agg(F.sum("n_signatures")).first()[0] or 0
    every = stored(shared_signatures(docs, most, total))
    enough = every.groupBy("doc_id", band.alias("band")).agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("doc_id", "band")
    enough = _small(stored(enough.join(copies.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")))
    shared = stored(every.withColumn("band", band).join(enough, ["doc_id", "band"], "left_semi").select("signature", "doc_id", "centre"))

    def of_firsts(pairs: DataFrame) -> DataFrame:
        """Pairs of different sets: copies stand for the first document of their set."""
        pairs = pairs.join(copies.select(F.col("a").alias("b"), F.col("b").alias("first")), "b", "left").withColumn("b", F.coalesce("first", "b")).drop("first")
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    near = _small(stored(shared.select("doc_id").distinct()))
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(near, "doc_id", "left_semi"))
    weighed = texts.withColumn("n_shingles", F.octet_length("text") / 6)
    star = of_firsts(shared.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct())
    star = stored(star.groupBy("a").agg(F.min("b").alias("b")))  # one centre for each document; the others count where it is not similar
    edges = cut(copies.unionByName(similar(star, texts)))
    found = connected_components(edges)
    split = cut(_with_class(shared.select("signature", "doc_id"), found))
    if not split.isEmpty():
        found = connected_components(edges.unionByName(cut(_across(split, weighed))))
    return about.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def firsts_of_classes(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with its columns; documents without doc_id all stay.

    Rows that share a doc_id but not the text are documents of their own, numbered in the order of doc_id and a hash
    of the text (all texts without words count as one); of equal rows by these the smallest by all columns stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key_hash = F.xxhash64(F.when(text.rlike(r"^[ \t\n\r\x0b\f]*$"), F.lit("")).otherwise(text))
    with_id = docs.where("doc_id is not null")
    if with_id.groupBy(F.col("doc_id").cast("long")).count().where("count > 1").isEmpty():
        later = classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("later_id"))
        return docs.join(later, docs["doc_id"].cast("long") == later["later_id"], "left_anti")
    rows = with_id.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("key_id"), key_hash.alias("key_hash"), text.alias("text"))
    nodes = stored(rows.select("key_id", "key_hash").distinct().orderBy("key_id", "key_hash").withColumn("node", F.monotonically_increasing_id()))
    numbered = rows.join(nodes, ["key_id", "key_hash"])
    later = classes(numbered.select(F.col("node").alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("node")).distinct()
    left = numbered.join(later, "node", "left_anti").groupBy("node").agg(F.min("row").alias("row")).select("row.*")
    return left.unionByName(docs.where("doc_id is null"))


def op8_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op8_partenum": op8_partenum}
ORACLE_SQL = {
    "op8_partenum": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pairs p JOIN n i ON i.doc_id = p.x JOIN n j ON j.doc_id = p.y WHERE 100 * c >= 80 * (i.n + j.n - c)),
reach(d, r) AS (SELECT x, y FROM link UNION SELECT reach.d, link.y FROM reach JOIN link ON reach.r = link.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(r) AS m FROM reach GROUP BY d) USING (doc_id)""",
}
