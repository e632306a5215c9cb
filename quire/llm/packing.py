"""Packing of tokenized documents into sequences by length patterns fitted with non-negative least squares.

The plan needs the histogram of piece lengths only, which has at most `size` bins however large the corpus
is. Patterns of two to four lengths that fill a sequence (or nearly) are enumerated over the lengths
present; repeat counts are fitted to the histogram by non-negative least squares (projected accelerated
gradient over the patterns' index arrays), rounded down to what the histogram still holds, and the residual
is packed by best fit on the histogram: the longest piece left, completed by one, two or else greedily
chosen pieces that leave the least room.

Pieces meet the plan by rank: the pieces of a length are numbered, and a slot of a pattern takes a run of
numbers. Numbering deals the pieces of each length over buckets of about `rows_a_bucket` rows, so that no
common length lands in one task. The plan is broadcast: it has a few segments a length, so its size is bounded by `size`.

Defined cases: a null or empty text is one piece of one token; repeated rows, also those without a doc_id, are packed each for
itself; very long texts are encoded in pieces and only their ids are held whole; an empty table packs nothing; extra columns are
ignored. Documents of up to `size` tokens are never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import in_slices, released, stored, table
from quire.llm.tokens import encoder

SIZE = 2048
END_OF_TEXT = 0


def pieces_of(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(path), np.array([END_OF_TEXT], "<u4")
        for batch in in_slices(batches, 1024):
            encoded = [np.append(ids, end) for ids, _ in known.encode([t or "" for t in batch.column(1).to_pylist()])]
            tokens = np.array([len(ids) for ids in encoded])
            counts = -(-tokens // size)
            piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            length = np.minimum(size, np.repeat(tokens, counts) - piece * size)
            crc = np.fromiter((zlib.crc32(ids[s : s + size]) for ids in encoded for s in range(0, len(ids), size)), np.int64, len(piece))
            doc = batch.column(0).take(pa.array(np.repeat(np.arange(len(encoded)), counts)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def enumerate_patterns(present: np.ndarray, size: int = SIZE, spread: int = 24) -> np.ndarray:
    """Patterns of up to four lengths in falling order, 0 for an unused slot, each filled up with the longest length that still fits."""
    present = np.sort(present)
    fitting = np.zeros(size + 1, np.int64)  # the longest length present that is no longer than the index
    fitting[present] = present
    fitting = np.maximum.accumulate(fitting)
    found = [np.array([[n, 0, 0, 0] for n in present])]
    a = present[::-1]
    for back in range(3):  # pairs: the best partner and the next shorter ones
        b = fitting[np.maximum(size - a - back, 0)]
        found.append(np.stack([a, b, fitting[np.maximum(size - a - b, 0)], np.zeros_like(a)], axis=1))
    for shares in np.linspace(0.04, 0.96, spread):  # triples and quadruples: a second length by share of the room, then the best rest
        b = fitting[((size - a) * shares).astype(np.int64)]
        c = fitting[np.maximum(size - a - b, 0)]
        found.append(np.stack([a, b, c, fitting[np.maximum(size - a - b - c, 0)]], axis=1))
        half = fitting[np.maximum(size - a - b, 0) // 2]
        found.append(np.stack([a, b, half, fitting[np.maximum(size - a - b - half, 0)]], axis=1))
    every = np.concatenate(found)
    every = every[(every.sum(axis=1) <= size) & (every[:, 0] > 0)]
    return np.unique(-np.sort(-every, axis=1), axis=0)


def fit(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of patterns that bring their summed lengths closest to the histogram, in squares weighted by 1 / (count + 1)."""
    weight, flat, slots = 1 / (histogram + 1.0), patterns.ravel(), patterns.shape[1]
    weight[0] = 0  # an unused slot

    def made(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, slots), len(histogram))

    def back(r: np.ndarray) -> np.ndarray:
        return (weight * r)[flat].reshape(-1, slots).sum(axis=1)

    v, bound = np.ones(len(patterns)), 1.0
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(made(v))
        bound = np.linalg.norm(v) or 1.0
        v /= bound
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        step = np.maximum(0, y - back(made(y) - histogram) / (1.05 * bound))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = step + (t - 1) / later * (step - x), step, later
    return x


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they use up the histogram (index: length)."""
    left, out = histogram.astype(np.int64).copy(), []

    def take(pattern: tuple[int, ...], most: int) -> None:
        need = {n: pattern.count(n) for n in pattern}
        times = min(most, *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            out.append((pattern, times))
            for n, k in need.items():
                left[n] -= k * times

    if left[size]:
        take((size,), int(left[size]))
    if not left.any():
        return out
    patterns = enumerate_patterns(np.flatnonzero(left), size)
    x = fit(patterns, left.astype(float))
    waste = size - patterns.sum(axis=1)
    for k in np.lexsort((-x, waste)):
        if x[k] >= 1 and waste[k] <= size // 64:
            take(tuple(int(n) for n in patterns[k] if n), int(x[k]))
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        pattern, room = [longest], size - longest
        while room and (here := np.flatnonzero(left[: room + 1])).size:
            best = int(here[-1])
            if best < room:
                rest = room - here  # two that fill the room
                pairs = here[(rest >= here) & (left[rest] > (rest == here))]
                if pairs.size:
                    best = int(room - pairs[0])
            pattern.append(best)
            left[best] -= 1
            room -= best
        for n in pattern:
            left[n] += 1
        take(tuple(pattern), int(left.sum()))
    return out


def segments_of(used: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each slot of each pattern the run of ranks it takes: length, first and last rank, the sequence of the first, and the offset."""
    rank, sequence, rows = {}, 0, []
    for pattern, times in used:
        offset = 0
        for n in pattern:
            first = rank.get(n, 0)
            rows.append((n, first, first + times - 1, sequence, offset))
            rank[n], offset = first + times, offset + n
        sequence += times
    return dict(zip(("length", "first_rank", "last_rank", "first_sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, size: int = SIZE, rows_a_bucket: int = 500) -> DataFrame:
    """pieces with sequence_id and offset. pieces: doc_id, piece, start, length and more; read twice, so best a stored table."""
    spark = pieces.sparkSession
    histogram = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `size` rows
        histogram[r["length"]] = r["count"]
    segments = segments_of(plan(histogram, size))
    rows = list(zip(*(x.tolist() for x in segments.values()), strict=True))
    slots = F.broadcast(spark.createDataFrame(rows, "slot_length long, first_rank long, last_rank long, first_sequence long, offset long"))
    buckets = 1 + int(histogram.max()) // rows_a_bucket
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start")) - 1
    ranked = dealt.withColumn("nth", nth).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(slots, (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    return placed.select(*pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Documents are encoded once; the pieces (without ids) are stored and read for the histogram and for the placing."""
    return pack(stored(pieces_of(docs, path, size)), size)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_pattern_packing": op4_pattern_packing}
ORACLE_SQL: dict[str, str] = {}
