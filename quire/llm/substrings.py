"""Repeated passages by compaction of a de Bruijn graph over words.

The graph. An edge is a window of `window` words; it leads from the node of its first words (one fewer) to
that of its last. A node is known by a 64-bit hash, an edge by its node and the word after it. Edges that
occur in one document only cannot be part of a repeated passage, so they are kept out by an exact filter: equal
windows have equal minimizers (the smallest hash of the 5-word runs inside), and only windows whose minimizer
occurs in at least two documents enter the graph.

Compaction. Edges are combined where they are made: of an edge that several documents of a batch share, only the
smallest one's travels by its node, in one row however often the document repeats it; the others have that one as
their source and compact to paths at once. Windowed over the node, the firsts of
all batches (one row an edge and batch) find the first source (smallest doc_id, then position) of each edge and whether several edges leave
the node. Brought together by document, consecutive edges and paths compact to one path while nodes do not fork
and their sources are consecutive in one document too.

Verification. Every compacted span is checked against the words at its source's coordinates by a 128-bit
digest of the words themselves; only spans that agree are removed.

A word is removed if a span covers it that also starts in a document with a smaller doc_id. Documents that
equal one with a smaller doc_id never enter the graph: all their windows stand there. No join or group
holds more than one row a document and position, and frequent passages meet in aggregates that combine first
or in joins that adaptive execution splits.

Defined cases: null text has no words; fewer words than a window: nothing is removed; rows with equal doc_id
are not smaller than each other, and each is judged by its own text; a null doc_id is kept and takes no part; a very long text is hashed in
pieces of some 64 KiB and its edges are combined like those of many; a span whose digest differs from its source's stays (an edge is known by 95 bits, so
that two are taken for one with a chance of 2 ** -95 a pair, and of 2 ** -31 for two words after one node);
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import MIX_C, binary, cut, in_slices, mixed, rolled, table, word_hashes

WINDOW, RUN = 13, 5
#: Rows that a task combines at a time.
MOST = 1_000_000


def minimizers(h: np.ndarray, window: int, run: int) -> np.ndarray:
    """For every window the smallest hash among its runs."""
    r = rolled(h, run)
    n = len(h) - window + 1
    out = r[:n].copy()
    for j in range(1, window - run + 1):
        np.minimum(out, r[j : j + n], out=out)
    return out


def local_firsts(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in `order` that sort equal keys together: which rows are the first of their key, and the index of each row's first."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return new, order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]


def anchors(docs: DataFrame, window: int, run: int, most: int) -> DataFrame:
    """(key, doc_id, anchor): the distinct minimizers of each document, combined over about `most` of them.

    The first of an anchor in a combined batch has the anchor as its key and, if others in the batch have it, as `anchor`; the
    others are known to be repeated, so they have the anchor and a key that deals them elsewhere.
    """

    def combined(keys: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        doc, anchor = np.concatenate(keys), np.concatenate(values)
        order = np.lexsort((doc, anchor))
        new, _ = local_firsts(order, anchor)
        doc, anchor = doc[order], anchor[order]
        lonely = new & np.append(new[1:], True)
        key = np.where(new, anchor, mixed(anchor ^ doc.view(np.uint64)))
        by_doc = np.argsort(doc, kind="stable")  # rows of one document together compress well
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[by_doc]), pa.array(doc[by_doc]), pa.array(anchor.view(np.int64)[by_doc], mask=lonely[by_doc]), pa.array(new[by_doc])], names=["key", "doc_id", "anchor", "first"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for batch in in_slices(batches):
            for key, h in zip(batch.column(0).to_pylist(), word_hashes(binary(batch.column(1))), strict=True):
                if len(h) >= window:
                    values.append(np.unique(minimizers(h, window, run)))
                    keys.append(np.full(len(values[-1]), key, np.int64))
                    held += len(values[-1])
            if held > most:
                yield combined(keys, values)
                keys, values, held = [], [], 0
        if held:
            yield combined(keys, values)

    return docs.mapInArrow(found, "key long, doc_id long, anchor long, first boolean")


def repeated_anchors(docs: DataFrame, window: int, run: int, most: int) -> DataFrame:
    """(doc_id, anchors) of the anchors that at least two documents have."""
    n = F.count("*").over(Window.partitionBy("key"))
    rows = anchors(docs, window, run, most).withColumn("n", n).where(F.col("anchor").isNotNull() | (F.col("first") & (F.col("n") > 1)))
    return rows.select("doc_id", F.coalesce("anchor", "key").alias("anchor")).groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))


def _edges(window: int, run: int, most: int):
    """The edges of documents' candidate windows, combined over about `most` of them.

    An edge's first document in a batch has one row for it: its node as key, its first position, and its other positions in `also`.
    All others have a source in the batch, so they need no meeting by node: consecutive ones are one row of `n` edges.
    """

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        node, after, doc, pos = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((pos, doc, after, node))
        node, after, doc, pos = node[order], after[order], doc[order], pos[order]
        every = np.arange(len(order))
        lead, first = local_firsts(every, node, after)
        own = doc == doc[first]  # the first document's repeats may have a source in another batch
        forks = np.zeros(len(order), bool)  # nodes with several edges in this batch
        forks[1:] = (node[1:] == node[:-1]) & (after[1:] != after[:-1])
        start, _ = local_firsts(every, node)
        group = np.cumsum(start) - 1
        forked = (np.bincount(group, forks) > 0)[group]

        at = np.flatnonzero(~own)
        at = at[np.lexsort((pos[at], doc[at]))]
        begin = np.ones(len(at), bool)
        begin[1:] = (doc[at][1:] != doc[at][:-1]) | (pos[at][1:] != pos[at][:-1] + 1)
        begin[1:] |= (doc[first[at]][1:] != doc[first[at]][:-1]) | (pos[first[at]][1:] != pos[first[at]][:-1] + 1) | forked[at][1:]
        begins = np.flatnonzero(begin)
        heads, size = at[begins], np.diff(np.append(begins, len(at)))

        leads = np.flatnonzero(lead)
        more = np.bincount((np.cumsum(lead) - 1)[own & ~lead], minlength=len(leads))
        rows = np.concatenate([leads, heads])
        alone = np.arange(len(rows)) < len(leads)
        by_doc = np.lexsort((pos[rows], doc[rows]))  # rows of one document together compress well
        also = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.append(more, np.zeros(len(heads), np.int64)))), pa.int32()), pa.array(pos[own & ~lead]), mask=pa.array(np.append(more == 0, np.ones(len(heads), bool))))
        key = np.where(alone, node[rows], mixed(node[rows] ^ (doc[rows] * 31 + pos[rows]).view(np.uint64))).view(np.int64)
        columns = [(key, None), (after[rows], ~alone), (doc[rows], None), (pos[rows], None), (np.append(np.ones(len(leads), np.int64), size).astype(np.int32), alone), (doc[first[rows]], alone), (pos[first[rows]], alone), (forked[rows], alone)]
        arrays = [pa.array(x[by_doc], mask=None if m is None else m[by_doc]) for x, m in columns]
        return pa.RecordBatch.from_arrays([*arrays, also.take(pa.array(by_doc))], names=["key", "after", "doc_id", "pos", "n", "source", "source_pos", "forks", "also"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in in_slices(batches, 256):
            for key, h, own in zip(batch.column(0).to_pylist(), word_hashes(binary(batch.column(1))), batch.column(2), strict=True):
                if len(h) < window:
                    continue
                at = np.flatnonzero(np.isin(minimizers(h, window, run), own.values.to_numpy().view(np.uint64)))
                word = (h & np.uint64(0x7FFFFFFF)).astype(np.int32)
                parts.append((rolled(h, window - 1, MIX_C)[at], word[at + window - 1], np.full(len(at), key, np.int64), at.astype(np.int32)))
                held += len(at)
            if held > most:
                yield combined(parts)
                parts, held = [], 0
        if held:
            yield combined(parts)

    return found


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 256):
        rows = []
        for key, text, wanted in zip(batch.column(0).to_pylist(), binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            rows += [(key, w["start"], w["size"], _digest(words[w["start"] : w["start"] + w["size"]])) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], [], []), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["source", "source_start", "size", "digest"])


def _removals(window: int):
    """n_words, and the removed word ranges of each document: merged spans whose words agree with their source's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 256):
            counts, removed, digests, starts, ends = [], [], [], [], []
            for text, spans, copy in zip(binary(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                own = [(0, len(words))] if copy and len(words) >= window else sorted((s["start"], s["start"] + s["size"]) for s in spans or () if _digest(words[s["start"] : s["start"] + s["size"]]) == s["digest"])
                merged: list[list[int]] = []
                for a, b in own:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                starts.append([a for a, _ in merged])
                ends.append([b for _, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "starts", "ends"])

    return run


def repeated_spans(docs: DataFrame, copies: DataFrame, window: int, run: int, most: int) -> DataFrame:
    """doc_id, start, size, source, source_start of every compacted path whose edges stand in a smaller document too."""
    own = repeated_anchors(docs, window, run, most).join(copies, "doc_id", "left_anti")
    edges = docs.join(own, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_edges(window, run, most), "key long, after int, doc_id long, pos int, n int, source long, source_pos int, forks boolean, also array<int>")
    at_node = Window.partitionBy("key")  # its exchange also serves the edges of a node
    nodes = edges.withColumn("forks", F.coalesce("forks", F.min("after").over(at_node) < F.max("after").over(at_node)))
    first = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("key", "after"))
    found = nodes.withColumn("first", F.when(F.col("source").isNull(), first)).where("doc_id is not null and (source is not null or first.doc_id < doc_id)")
    places = F.explode(F.concat(F.array("pos"), F.coalesce("also", F.array().cast("array<int>")))).alias("pos")
    sourced = found.select("doc_id", places, F.coalesce("n", F.lit(1)).alias("n"), "forks", F.coalesce("source", "first.doc_id").alias("source"), F.coalesce("source_pos", "first.pos").alias("source_pos"))
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    step = F.lag("n").over(by_doc)
    follows = (F.lag("pos").over(by_doc) + step == F.col("pos")) & (F.lag("source").over(by_doc) == F.col("source")) & (F.lag("source_pos").over(by_doc) + step == F.col("source_pos")) & ~F.col("forks")
    paths = sourced.withColumn("path", F.sum(F.when(follows, 0).otherwise(1)).over(by_doc))
    size = F.max(F.col("pos") + F.col("n")) - F.min("pos") + window - 1
    return paths.groupBy("doc_id", "path").agg(F.min("pos").alias("start"), size.cast("int").alias("size"), F.first("source").alias("source"), F.min("source_pos").alias("source_start")).drop("path")


def deduplicated(docs: DataFrame, *, window: int = WINDOW, run: int = RUN, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the removed word ranges (starts, ends) of every document."""
    kinds = dict(docs.dtypes)  # columns that need no cast keep their names, so that plans on them are alike and share one exchange
    every = docs.select(*(name if kinds[name] == kind else F.col(name).cast(kind).alias(name) for name, kind in (("doc_id", "bigint"), ("text", "string"))))
    known = every.where("doc_id is not null")
    hashed = known.where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    firsts = hashed.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = cut(hashed.join(firsts, "hash").where("doc_id > first").select("doc_id", "hash").distinct())
    # Not stored: in one query the texts are shuffled by document once, for the edges and for the removal alike.
    spans = repeated_spans(known, copies.select("doc_id"), window, run, most)
    wanted = spans.select(F.col("source").alias("doc_id"), F.struct(F.col("source_start").alias("start"), "size").alias("w")).distinct().groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    digests = known.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_digests, "source long, source_start int, size int, digest binary")
    checked = spans.join(digests.distinct(), ["source", "source_start", "size"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "digest")).alias("spans"))
    joined = known.join(checked, "doc_id", "left").join(copies.select("doc_id", F.lit(True).alias("copy"), F.col("hash")), "doc_id", "left")
    judged = joined.select("doc_id", "text", "spans", (F.col("copy") & (F.sha2("text", 256) == F.col("hash"))).alias("copy"))
    alone = every.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<start:int,size:int,digest:binary>>").alias("spans"), F.lit(False).alias("copy"))
    return judged.unionByName(alone).mapInArrow(_removals(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, starts array<int>, ends array<int>")


def op7_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op7_de_bruijn": op7_de_bruijn}
ORACLE_SQL = {
    "op7_de_bruijn": r"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM w WHERE len(w) >= 13)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS MATERIALIZED (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM hit) GROUP BY doc_id),
word AS (SELECT w.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w JOIN gone USING (doc_id)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word JOIN gone USING (doc_id) WHERE NOT list_contains(ps, p) GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  CASE WHEN ps IS NULL THEN sha256(array_to_string(w, ' ')) ELSE sha256(coalesce(t, '')) END AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
