"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

A text becomes a sparse vector: its lower-cased words by white space, hashed into `BUCKETS` places with
their counts scaled to unit length; statistics of its structure (shares of capitals, digits, symbols and
separators, word and line lengths, repeated words and lines), each as one of `BINS` places by its quantile
in the training rows; and its length likewise as metadata. Interactions of all pairs have rank `RANK`; they
are scored in linear time by the sum-of-squares identity: 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Training uses at most `most_rows` labelled rows (a documented bound; the ones with the smallest hash of
doc_id, so the same at every run); their sparse vectors (8 bytes a distinct word) come to the driver and the model, whose size
does not depend on the corpus, is broadcast. Scoring is a narrow operation over whole texts.

Defined cases: null text counts as empty; empty texts get a score from their (zero) statistics; a very long text is scored as
any other (memory grows with its distinct words); repeated rows each get their score; rows of equal features are ordered by their label, so
that the model is the same at every run; rows without a label, with a null label, or labelled twice with different labels are not learned from; without
any row to learn from every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import binary, give_back, in_slices, released, table

BUCKETS, BINS, RANK = 1 << 15, 8, 8
MOST_ROWS = 12_000
THRESHOLD = 0.3
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"!#$%&*+/<=>@\\^_`{}~", "bar": b"|", "stop": b".?", "comma": b",;:",
    "quote": b"\"'()[]", "space": b" \t\n\r\x0b\x0c",
}
STATISTICS = (*(f"{k}_share" for k in _CLASSES), "word_length", "distinct_words", "top_word", "line_length", "distinct_lines", "short_lines", "words_ending_in_symbols", "repeated_neighbours", "log_length")


def statistics_of(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n, m = max(1, len(raw)), max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    shares = [(len(raw) - len(raw.translate(None, c))) / n for c in _CLASSES.values()]
    ending = sum(c for w, c in counts.items() if w[-1] in b"!#$%&*|~^")
    return [*shares, (len(raw) - len(words)) / m, len(counts) / m**0.8, max(counts.values(), default=0) / m, math.log1p(n / k), len(set(lines)) / k, sum(len(x) < 30 for x in lines) / k, ending / m, sum(map(eq, words, islice(words, 1, None))) / m, math.log1p(len(raw))]


def features_of(raw: bytes | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Places and values of the hashed words, and the statistics."""
    words = (raw or b"").lower().split()
    counts = Counter(words)
    places = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % BUCKETS
    values = np.fromiter(counts.values(), np.float32, len(counts))
    norm = float(np.sqrt((values * values).sum())) or 1.0
    return places, values / norm, statistics_of(raw or b"", words, counts)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    cuts: np.ndarray  # statistics x (BINS - 1)

    def vector(self, places: np.ndarray, values: np.ndarray, statistics: list[float]) -> tuple[np.ndarray, np.ndarray]:
        s = np.asarray(statistics)
        bins = (s[:, None] > self.cuts).sum(axis=1, dtype=np.int32)
        return np.concatenate([places, BUCKETS + np.arange(len(s), dtype=np.int32) * BINS + bins], dtype=np.int32, casting="unsafe"), np.concatenate([values, np.full(len(s), 0.3, np.float32)], dtype=np.float32, casting="unsafe")

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
        """The scores of many rows at once, in linear time."""
        if not rows:
            return np.zeros(0)
        vectors = [self.vector(*r) for r in rows]
        i, x = (np.concatenate([v[k] for v in vectors]) for k in (0, 1))
        starts = np.cumsum([0, *(len(v[0]) for v in vectors[:-1])])
        v = self.factors[i].astype(np.float64) * x[:, None]
        s = np.add.reduceat(v, starts)
        z = self.bias + np.add.reduceat(self.linear[i].astype(np.float64) * x, starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts))
        return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))

    def score(self, places: np.ndarray, values: np.ndarray, statistics: list[float]) -> float:
        return float(self.scores([(places, values, statistics)])[0])


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adagrad on the logistic loss, in batches of 64."""
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows]).reshape(-1, len(STATISTICS))
    cuts = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(rows) else np.zeros((len(STATISTICS), BINS - 1))
    size = BUCKETS + len(STATISTICS) * BINS
    model = Model(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), cuts)
    if not len(rows):
        model.factors[:] = 0
        return model
    vectors = [model.vector(*r) for r in rows]
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    model.bias = math.log(share / (1 - share))
    gl, gf, gb = np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(vectors))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            i = np.concatenate([vectors[k][0] for k in batch])
            x = np.concatenate([vectors[k][1] for k in batch])
            sizes = [len(vectors[k][0]) for k in batch]
            starts = np.cumsum([0, *sizes[:-1]])
            v = model.factors[i] * x[:, None]
            s = np.add.reduceat(v, starts)
            z = model.bias + np.add.reduceat(model.linear[i] * x, starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)).astype(np.float32)
            each = np.repeat(g, sizes)
            used, where = np.unique(i, return_inverse=True)
            dl = np.bincount(where, each * x, len(used)).astype(np.float32) + decay * model.linear[used]
            wide = (each * x)[:, None] * (np.repeat(s, sizes, axis=0) - v)
            df = np.stack([np.bincount(where, wide[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + decay * model.factors[used]
            gl[used] += dl * dl
            gf[used] += df * df
            model.linear[used] -= rate * dl / np.sqrt(gl[used])
            model.factors[used] -= rate * 0.3 * df / np.sqrt(gf[used])
            db = float(g.sum())
            gb += db * db
            model.bias -= rate * db / math.sqrt(gb)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        rows = [features_of(t) for t in binary(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["label", "places", "x", "statistics"])


def fitted(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """A model of labels[label] from the rows that are not held out; at most most_rows of them."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows).select("label_id", F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id")).select("label", F.col("text").cast("string")).mapInArrow(released(_featurised), "label int, places array<int>, x array<float>, statistics array<double>")
    got = rows.toArrow()
    features = [(p.values.to_numpy(), x.values.to_numpy(), s.as_py()) for p, x, s in zip(got["places"], got["x"], got["statistics"], strict=True)]  # views of Arrow's memory
    label_of = got["label"].to_pylist()
    # rows come in any order; those that agree in the key have the same words, or the same hashed places
    order = sorted(range(len(features)), key=lambda k: (len(features[k][0]), features[k][2], label_of[k], zlib.crc32(features[k][0]), zlib.crc32(features[k][1])))
    model = train([features[k] for k in order], np.array(label_of, np.float32)[order])
    del rows, got, features
    give_back()
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 128, 2 << 20):
            scores = shared.value.scores([features_of(t) for t in binary(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, score double, predicted int")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model predicts to be good, with their columns unchanged; narrow, as scoring is."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 128, 2 << 20):
            yield batch.filter(pa.array(shared.value.scores([features_of(t) for t in binary(batch.column(at))]) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)


def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op3_factorisation_machine": op3_factorisation_machine}
ORACLE_SQL: dict[str, str] = {}
