"""What several operators share: reading tables, checkpoints, word hashes and connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a session on this one machine (local mode) gets a folder of its own; a cluster has to name one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from the files, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table in the shared folder: columnar and compressed, for larger intermediates."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def give_back() -> None:
    """Returns memory that this process no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker gives back what it no longer uses: workers live on through the stages of a job, beside the JVM's heap."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def binary(column: pa.Array) -> list:
    """A text column as UTF-8 bytes, without decoding; null stays None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of few rows and about `size` bytes (or one row), so that what is made from a batch stays small whatever the session's Arrow settings are."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Characters of a word that are hashed by table; longer words are hashed one by one.
TABLED = 32
_random = np.random.Generator(np.random.PCG64(20240607))
_LOW = _random.integers(0, 1 << 64, TABLED << 8, np.uint64)
_HIGH = _random.integers(0, 1 << 64, TABLED * 0x1100, np.uint64)


def run_hashes(codes: np.ndarray, gap: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of codes (bytes or code points): a run goes from its start to the next gap or start.

    Tabulation: every character adds a random number of its value and place, so two given runs meet with a chance of 2 ** -64
    over the choice of the tables, whatever their pattern. Runs of more than TABLED characters are hashed by XXH3."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes, gap, at = codes[starts[0] :], gap[starts[0] :], (starts - starts[0]).astype(np.int32)
    place = np.arange(len(codes), dtype=np.int32) - np.repeat(at, np.diff(at, append=np.int32(len(codes))))
    np.minimum(place, TABLED - 1, out=place)
    values = _LOW[(place << 8) | (codes & 0xFF)]
    if codes.itemsize > 1:
        high = np.flatnonzero(codes > 0xFF)
        values[high] += _HIGH[place[high] * 0x1100 + (codes[high] >> 8).astype(np.int32)]
    values[gap] = 0
    sums = np.add.reduceat(values, at)
    # A run that goes on at the last place of the tables may be too long for them.
    last = place == TABLED - 1
    last &= ~gap
    for k in np.unique(np.searchsorted(at, np.flatnonzero(last), "right") - 1).tolist():
        run = slice(at[k], at[k + 1] if k + 1 < len(at) else len(codes))
        run = codes[run][~gap[run]]
        if len(run) > TABLED:
            sums[k] = xxhash.xxh3_64_intdigest(run.tobytes())
    return mixed(sums)


_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_NEXT_GAP = re.compile(rb"[ \t-\r]")


def _hashed_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(raw, np.uint8)
    gap = _GAP[codes]
    start = ~gap
    start[1:] &= gap[:-1]
    starts = np.flatnonzero(start)
    return starts, run_hashes(codes, gap, starts)


def word_hashes(texts: list[bytes | None], piece: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hashes of each text's words (by ASCII white space). Short texts are hashed together and long ones in pieces of about `piece` bytes."""
    held, size = [], 0

    def out() -> Iterator[np.ndarray]:
        starts, hashes = _hashed_piece(b" ".join(held))
        ends = np.cumsum([len(t) + 1 for t in held])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        text = text or b""
        if size + len(text) > piece and held:
            yield from out()
            held, size = [], 0
        if len(text) <= piece:
            held.append(text)
            size += len(text) + 1
            continue
        parts, at = [], 0
        while at < len(text):
            m = _NEXT_GAP.search(text, min(len(text), at + piece))
            end = m.start() if m else len(text)
            parts.append(_hashed_piece(text[at:end])[1])
            at = end
        yield np.concatenate(parts)
    if held:
        yield from out()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    h = (h ^ (h >> np.uint64(27))) * MIX_C
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, width: int, seed: np.uint64 = MIX_A) -> np.ndarray:
    """Hashes of all runs of `width` consecutive word hashes; empty where there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * seed + h[j : j + n]
    return mixed(out ^ seed)


def flat_list(values: np.ndarray, counts: np.ndarray | list[int], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def connected_components(edges: DataFrame, most_rounds: int = 60, edges_a_task: int = 100_000) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is two grouped
    minima, combined before the shuffle, and two joins, whose hot side adaptive execution splits. The
    edges shrink to one star for each component; that they have is seen from one grouped count, of which
    a single row comes to the driver. A round runs in a task for each edges_a_task edges, so that small graphs leave few files.

    edges: columns a, b of one integral type. Rows with a null or with a = b link nothing.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = 1 + stars.count() // edges_a_task
    for _ in range(most_rounds):
        ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(stars.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        odd = ends.coalesce(tasks).groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1")
        if odd.coalesce(tasks).agg(F.count("*")).first()[0] == 0:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x")), F.struct(F.col("v").alias("x")))).alias("e"), "m").select(F.col("e.x").alias("u"), F.col("m").alias("v"))
        stars = cut(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
