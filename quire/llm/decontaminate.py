"""Benchmark decontamination: an FM-index over each shard of the corpus is searched for benchmark phrases.

A window is `window` consecutive words of a benchmark item (an item of fewer words is one window). A shard
is one Arrow batch of documents. Words that no benchmark item has cannot be part of an occurrence, so runs of
benchmark words shorter than the shortest window are left out and the remaining runs, each ended by a
separator, are the indexed sequence of word numbers. The index holds the Burrows-Wheeler transform of that
sequence in a wavelet matrix with rank counts, the cumulative symbol counts, and every `sample`-th suffix
position. Windows are matched by backward search, all at once, and located by walking back to a sampled
position; the hit words of a document are the merged spans of its occurrences.

The benchmark is the broadcast side: it is split by size into parts of at most `part_words` words (a proven
bound on what a task receives: arrays of window words as 32-bit numbers, some 60 bytes a word, and the distinct words), and each
part is searched over all documents. With one part, as for any benchmark of usual size, there is no shuffle at all; the hits of
more parts are merged by doc_id and text.

Defined cases: null or wordless text has no words and no hits; items that are null or wordless have no
window; equal items all count, as do equal item_ids (once) and items without an id (as one, null); every row of documents
gives a row and is judged by itself, also where doc_ids are null or repeat; a very long text is a shard of its own; extra
columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import binary, flat_list, in_slices, released, stored, table

WINDOW = 13
PART_WORDS = 500_000
#: Bytes that are word characters after lower-casing keep their place, all others become spaces.
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


class WaveletMatrix:
    """Ranks of symbols in an integer sequence: one bit vector for each bit, with counts before every 64-bit word."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, self.bits, self.n = [], bits, len(values)
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            before = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            zeros = self.n - int(before[-1])
            self.levels.append((packed, before, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position `at`."""
        start, at = np.zeros_like(at), at.copy()
        for k, (packed, before, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            s, a = self._ones(packed, before, start), self._ones(packed, before, at)
            start, at = np.where(one, zeros + s, start - s), np.where(one, zeros + a, at - a)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for packed, before, zeros in self.levels:
            bit = (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(packed, before, at)
            out = (out << 1) | bit.astype(np.int64)
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out


class FMIndex:
    """An FM-index over a sequence of numbers from 1 up; 0 ends the sequence."""

    def __init__(self, sequence: np.ndarray, alphabet: int, sample: int = 8):
        text = np.append(sequence, 0).astype(np.int64)
        suffixes = self._suffixes(text)
        self.bits = max(1, int(alphabet).bit_length())
        bwt = text[suffixes - 1]
        self.wavelet = WaveletMatrix(bwt, self.bits)
        self.before = np.zeros(alphabet + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet + 1), out=self.before[1:])
        kept = suffixes % sample == 0
        self.kept, self.kept_before, self.positions = kept, np.cumsum(kept) - kept, suffixes[kept]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling; the 0 at the end makes all suffixes differ."""
        n, rank, step = len(text), text.copy(), 1
        while True:
            later = np.zeros(n, dtype=np.int64)
            later[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max(initial=0)) + 2 if step > 1 else int(text.max(initial=0)) + 2) + later
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, dtype=np.int64)
            new[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            if int(new.max(initial=0)) == n - 1:
                return order
            rank, step = new, step * 2

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases of one length, one a row, by backward search; a phrase whose range is empty is left alone."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.wavelet.n, dtype=np.int64)
        left = np.arange(len(phrases))
        for column in phrases.T[::-1]:
            symbol = column[left].astype(np.int64)
            low[left] = self.before[symbol] + self.wavelet.rank(symbol, low[left])
            high[left] = np.maximum(low[left], self.before[symbol] + self.wavelet.rank(symbol, high[left]))
            left = left[high[left] > low[left]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a sampled one is met."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            done = self.kept[at]
            out[left[done]] = self.positions[self.kept_before[at[done]]] + steps[left[done]]
            left = left[~done]
            symbol = self.wavelet.access(rows[left])
            rows[left] = self.before[symbol] + self.wavelet.rank(symbol, rows[left])
            steps[left] += 1
        return out


class Phrases:
    """The windows of one part of the benchmark, by length, over numbered words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        self.items = sorted({i for i, _ in items if i is not None}) + [None] * any(i is None for i, _ in items)
        place = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 2) for w in words_of(text)], np.int32)
            if len(ids):
                width = min(window, len(ids))
                found, owners = by_length.setdefault(width, ([], []))
                found.append(np.lib.stride_tricks.sliding_window_view(ids, width))
                owners.append(np.full(len(ids) - width + 1, place[item], np.int32))
        self.size, self.shortest = len(self.numbers) + 1, min(by_length, default=0)
        #: for each length the distinct windows, and the items of each as bounds into a list
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, (found, owners) in by_length.items():
            windows, owner = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((owner, *windows.T))
            windows, owner = windows[order], owner[order]
            new = np.append(True, (windows[1:] != windows[:-1]).any(axis=1))
            fresh = new | np.append(True, owner[1:] != owner[:-1])  # an item counts once for a window
            first = np.cumsum(fresh) - 1
            self.windows[width] = (windows[new], np.append(first[new], fresh.sum()), owner[fresh])

    def search(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, set[int]]]:
        """For each document its hit spans (starts, ends, merged and in order) and the items that occur."""
        get, sequences, sources, places = self.numbers.get, [], [], []
        for d, words in enumerate(docs):
            if not self.shortest or len(words) < self.shortest:
                continue
            ids = np.array([get(w, 0) for w in words], dtype=np.int64)
            edge = np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for s, e in zip(starts, ends, strict=True):
                if e - s >= self.shortest:
                    sequences += [ids[s:e], [1]]
                    sources.append(np.full(e - s + 1, d))
                    places.append(np.arange(s, e + 1))
        none = np.zeros(0, dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, set[int]]] = [(none, none, set()) for _ in docs]
        if not sequences:
            return found
        sequence, source, place = np.concatenate(sequences), np.concatenate(sources), np.concatenate(places)
        index = FMIndex(sequence, self.size)
        spans, items = [], {}
        for width, (phrases, bounds, owners) in self.windows.items():
            low, high = index.ranges(phrases)
            some = np.flatnonzero(high > low)
            if not len(some):
                continue
            counts = (high - low)[some]
            rows = np.repeat(low[some] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            at = index.locate(rows)
            spans.append(np.stack([source[at], place[at], place[at] + width], axis=1))
            for d, w in set(zip(source[at].tolist(), np.repeat(some, counts).tolist(), strict=True)):
                items.setdefault(d, set()).update(owners[bounds[w] : bounds[w + 1]].tolist())
        if spans:
            s = np.concatenate(spans)
            s = s[np.lexsort((s[:, 1], s[:, 0]))]
            cuts = np.flatnonzero(np.append(True, s[1:, 0] != s[:-1, 0]))
            for part in np.split(s, cuts[1:]):
                reach = np.maximum.accumulate(part[:, 2])
                new = np.append(True, part[1:, 1] > reach[:-1])
                found[part[0, 0]] = (part[new, 1], reach[np.append(np.flatnonzero(new)[1:] - 1, len(part) - 1)], items[part[0, 0]])
        return found


def benchmark_parts(benchmark: DataFrame, part_words: int = PART_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in parts of at most part_words words (or one item), streamed to the driver one at a time."""
    rows, held = [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        n = len(words_of(bytes(r[1])))
        if rows and held + n > part_words:
            yield rows
            rows, held = [], 0
        rows.append((r[0], bytes(r[1])))
        held += n
    yield rows


def find_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, text_hash, n_words, span_starts, span_ends (word numbers, merged, ends exclusive) and items (ids as strings, sorted, all items without an id as one null at the end).

    One row for every row of docs, whatever the number of parts: what further parts find is joined by doc_id and text_hash.
    """
    spark = docs.sparkSession
    schema = "doc_id long, text_hash long, n_words long, span_starts array<long>, span_ends array<long>, items array<string>"

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in in_slices(batches, 2048):
                docs = [words_of(t) for t in binary(batch.column(1))]
                found = phrases.search(docs)
                names = [[phrases.items[i] for i in sorted(x)] for *_, x in found]
                arrays = [batch.column(0), batch.column(2), pa.array([len(w) for w in docs], pa.int64())]
                arrays += [flat_list(np.concatenate([f[k] for f in found]), [len(f[k]) for f in found], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "span_starts", "span_ends", "items"])

        return docs.select(F.col("doc_id").cast("long"), "text", _text_hash(F.col("text")).alias("text_hash")).mapInArrow(released(run), schema)

    found = [searched(spark.sparkContext.broadcast(Phrases(part, window))) for part in benchmark_parts(benchmark, part_words)]
    if len(found) == 1:
        return found[0]
    key = ["doc_id", "text_hash"]
    found[0] = stored(found[0])
    hits = [x.where(F.size("span_starts") > 0).dropDuplicates(key) for x in found]
    merged = hits[0]
    for more in hits[1:]:
        merged = merged.unionByName(more)
    spans = merged.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("span_starts", "span_ends")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["span_starts"].alias("span_starts"), F.greatest(last["span_ends"], x["span_ends"]).alias("span_ends"))))
        return F.when((F.size(acc) > 0) & (x["span_starts"] <= F.try_element_at(acc, F.lit(-1))["span_ends"]), grown).otherwise(F.concat(acc, F.array(x)))

    joined = F.aggregate("spans", F.expr("cast(array() as array<struct<span_starts:bigint,span_ends:bigint>>)"), step)
    spans = spans.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), joined.alias("spans"), "items")
    rows = found[0].select("doc_id", "text_hash", "n_words").join(spans, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    columns = {"span_starts": F.col("spans.span_starts"), "span_ends": F.col("spans.span_ends"), "items": F.col("items")}
    return rows.select("doc_id", "text_hash", "n_words", *(F.coalesce(x, F.array().cast(kind)).alias(c) for (c, x), kind in zip(columns.items(), ("array<long>", "array<long>", "array<string>"), strict=True)))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items and contaminated: at least a twentieth of the words hit."""
    found = find_spans(docs, benchmark, **options)
    hit = F.aggregate(F.zip_with("span_starts", "span_ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", hit).withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The documents that are not contaminated, unchanged; each row is judged by its own text.

    With one part of the benchmark the rows are judged and kept in the pass that searches them, without a shuffle.
    """
    parts = benchmark_parts(benchmark, part_words)
    first, more = next(parts), next(parts, None)
    if more is not None:
        bad = contamination(docs, benchmark, window=window, part_words=part_words).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
        return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (_text_hash(docs["text"]) == bad["bad_hash"]), "left_anti")
    shared, at = docs.sparkSession.sparkContext.broadcast(Phrases(first, window)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2048):
            words = [words_of(t) for t in binary(batch.column(at))]
            hits = [int((ends - starts).sum()) for starts, ends, _ in shared.value.search(words)]
            yield batch.filter(pa.array([not (n and 20 * n >= len(w)) for n, w in zip(hits, words, strict=True)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def op9_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


QUERIES = {"op9_fm_index": op9_fm_index}
ORACLE_SQL = {
    "op9_fm_index": r"""
WITH dw AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS MATERIALIZED (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS MATERIALIZED (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
occ AS MATERIALIZED (SELECT DISTINCT d.doc_id, d.s, d.n, win.item_id FROM dg d JOIN win ON d.g = win.g AND d.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
