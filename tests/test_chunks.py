"""Print chunks against the greedy rule, one row after another."""

import random

import pytest

from quire.operators import chunks


def greedy(rows, most_rows, most_cells):
    """Chunks of rows (table, n_rows, n_cells): what is left is spent row by row, and a table's first row asks only whether anything is left."""
    out, chunk, left_rows, left_cells, table = [], 0, most_rows, most_cells, None
    for k, (t, a, c) in enumerate(rows):
        full = left_rows <= 0 or left_cells <= 0 if t != table else a > left_rows or c > left_cells
        if k and full:
            chunk, left_rows, left_cells = chunk + 1, most_rows, most_cells
        left_rows, left_cells, table = left_rows - a, left_cells - c, t
        out.append(chunk)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chunks(spark, seed):
    rng = random.Random(seed)
    docs = {d: sorted((rng.randrange(6), rng.choice([1, 1, 1, 2, 30]), rng.choice([1, 3, 3, 200])) for _ in range(n)) for d, n in (("a", 300), ("b", 1), ("c", 40))}
    docs = {d: [(t, a, c) for t, a, c in rows] for d, rows in docs.items()}
    data = [(d, t, r, a, c) for d, rows in docs.items() for r, (t, a, c) in enumerate(rows)]
    got = chunks.print_chunks(spark.createDataFrame(data, "doc string, table_no int, r int, n_rows int, n_cells int").repartition(3), 20, 90).orderBy("doc", "r").collect()
    for d, rows in docs.items():
        assert [r.chunk for r in got if r.doc == d] == greedy(rows, 20, 90)


@pytest.mark.parametrize("block", (1, 3))
def test_chunks_over_blocks(spark, monkeypatch, block):
    """Chunks go on from block to block, and only rows that a block can be entered at are followed by jumps."""
    monkeypatch.setattr(chunks, "BLOCK", block, raising=False)
    jumps, stored = [], chunks.stored
    monkeypatch.setattr(chunks, "stored", lambda df: jumps.append(stored(df)) or jumps[-1])
    rng = random.Random(block)
    docs = {d: sorted((rng.randrange(9), rng.choice([1, 1, 1, 1, 2, 9]), rng.choice([1, 3, 3, 60])) for _ in range(n)) for d, n in (("a", 400), ("b", 1), ("c", 13))}
    data = [(d, t, r, a, c) for d, rows in docs.items() for r, (t, a, c) in enumerate(rows)]
    got = chunks.print_chunks(spark.createDataFrame(data, "doc string, table_no int, r int, n_rows int, n_cells int").repartition(3), 5, 50).orderBy("doc", "r").collect()
    for d, rows in docs.items():
        assert [r.chunk for r in got if r.doc == d] == greedy(rows, 5, 50)
    most = max(df.count() for df in jumps if "next" in df.columns)
    assert block == 1 or most <= len(data) / block + 6
