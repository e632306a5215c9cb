"""Stated results that have no test beside their operator: ties, repeated rows, rows without ids, very long texts and empty tables."""

import math
import random
import zlib

import numpy as np
import pytest

from quire.llm import decontaminate, embeddings, jaccard, packing, quality, substrings, tokens
from tests.llm.test_operators import WORDS, corpus, prose


def test_embedding_components_and_recall(spark):
    """Components are those of the links found; of the pairs that brute force finds, at least nine in ten are links."""
    rng = np.random.default_rng(9)
    rows = [(10 * k + j, (c + rng.normal(size=16) * 0.12).tolist(), 1) for k, c in enumerate(rng.normal(size=(40, 16))) for j in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.classes(df, block=8).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    ids = [i for i, _, _ in rows]
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in zip(*np.nonzero(near), strict=True):
            root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
    assert sum(r.n_links for r in got.values()) >= 0.9 * near.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, near.sum(axis=1), strict=True))
    # With all links found the components are brute force's; a missed link can only split one.
    if sum(r.n_links for r in got.values()) == near.sum():
        assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.component_id >= root[i] and r.kept == (r.component_id == i) for i, r in got.items())
    assert all(got[r.component_id].component_id == r.component_id for r in got.values())


def test_embedding_ties(spark):
    """A cosine of 0.93 as doubles have it is a link, the next double below is none."""
    one, other = [1.0, 0.0], [0.93, math.sqrt(1 - 0.93**2)]
    exact = float(np.dot(np.array(one), np.array(other) / np.linalg.norm(other)))
    got = {r.vec_id: r.n_links for r in embeddings.classes(spark.createDataFrame([(1, one, 0), (2, other, 0)], "vec_id long, embedding array<double>, label int"), cosine=exact).collect()}
    assert set(got) == {1, 2} and got[1] == got[2]
    above = embeddings.classes(spark.createDataFrame([(1, one, 0), (2, other, 0)], "vec_id long, embedding array<double>, label int"), cosine=exact + 1e-9).collect()
    assert [r.n_links for r in above] == [0, 0]


def test_packing_of_repeated_and_nameless_rows(spark):
    texts = ["one two three"] * 5 + [None] * 3 + ["long " * 30_000]
    pieces = packing.packed_documents(corpus(spark, texts, [7, 7, 7, None, None, 8, None, None, 9]), WORDS).toPandas()
    ids = np.append(tokens.WordEncoder(WORDS).encode(["one two three"])[0][0], 0).astype("<u4")
    same = pieces[pieces.ids_crc32 == zlib.crc32(ids.tobytes())]
    assert len(same) == 5 and same.doc_id.isna().sum() == 2 and (same.length == len(ids)).all()
    assert (pieces.length == 1).sum() == 3 + (30_001 % 2048 == 1)
    assert pieces[pieces.doc_id == 9].length.sum() == 30_001 and pieces[pieces.doc_id == 9].length.max() == 2048
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048


def test_section_counts_of_repeated_empty_and_long(spark):
    long = "word two\n" * 40_000
    rows = tokens.section_counts(corpus(spark, ["a b", "a b", long], [1, 1, None]), WORDS).collect()
    assert len([r for r in rows if r.doc_id == 1]) == 2 and sum(r.n_tokens for r in rows if r.doc_id is None) == 80_000
    assert tokens.section_counts(corpus(spark, []), WORDS).count() == 0


def test_very_long_texts(spark):
    """Texts of 60,000 words: repeated passages, near copies and benchmark items in them are found."""
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    passage = base[41_000:41_060]
    changed = [*base[:30_000], "other", *base[30_001:]]
    docs = corpus(spark, [" ".join(base), " ".join([*prose(rng, 50).split(), *passage, *prose(rng, 50).split()]), " ".join(changed)])
    gone = {r.doc_id: r.n_removed for r in substrings.deduplicated(docs).collect()}
    assert gone[0] == 0 and gone[1] == 60 and gone[2] == 59_999
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got[2] == (len({tuple(changed[k : k + 5]) for k in range(59_996)}), 0) and got[0][1] == 0 and got[1][1] == 1
    bench = spark.createDataFrame([("i", " ".join(base[59_980:]))], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench).collect()} == {0: 20, 1: 0, 2: 20}


@pytest.mark.parametrize("copies", [1, 40])
def test_quality_of_repeated_rows_and_ties(spark, copies):
    """Equal texts with unlike labels train to a score between them; repeated rows are scored each for itself."""
    texts = ["good clean prose about rivers and hills"] * copies + ["buy buy buy now !!!"] * copies
    ids = [k for k in range(1, 10_000) if zlib.crc32(str(k).encode()) % 5][: 2 * copies]
    docs = corpus(spark, texts, ids)
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs.unionByName(docs), quality.fitted(docs, labels)).collect()
    assert len(rows) == 4 * copies and all(0 <= r.score <= 1 for r in rows)
    assert len({(r.doc_id, r.score) for r in rows}) == 2 * copies  # a row and its repetition score alike
