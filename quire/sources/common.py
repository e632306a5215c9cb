"""How a parser of one document becomes a DataFrame of many: a generator of rows for each document, batched by Arrow."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An error is a row's column, never the job's end.
ERROR = "error string"


def _pieces(rows: Iterable[tuple], batch: int) -> Iterator[list[tuple]]:
    """All rows in pieces, the first of them once the last is known: a failure comes before any piece, and a file of this task holds what is more than one."""
    rows = iter(rows)
    first = list(islice(rows, batch))
    if len(first) < batch:
        yield first
        return
    with tempfile.TemporaryFile() as file:
        n = 0
        while piece := list(islice(rows, batch)):
            pickle.dump(piece, file, pickle.HIGHEST_PROTOCOL)
            n += 1
        file.seek(0)
        yield first
        for _ in range(n):
            yield pickle.load(file)


def parsed(df: DataFrame, column: str, schema: str, parse: Callable[..., Iterable[tuple]], *, doc: str = "doc", batch: int = 10_000) -> DataFrame:
    """(doc, <schema>, error) of the rows that parse() yields for each document; a null input yields none, a failure one row with its error and no other.

    schema: names and types without doc, e.g. "pos int, text string". Memory holds a document and a batch of rows, not all rows of a document.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []

        def frame() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["doc", *names, "error"], dtype=object)

        for part in parts:
            for key, value in zip(part["doc"], part["input"], strict=True):
                if value is None:
                    continue
                pieces = iter(())
                try:
                    pieces = _pieces(((key, *row, None) for row in parse(value)), batch)
                    piece = next(pieces)  # all of a document or none
                except Exception as e:  # noqa: BLE001  whatever a broken file does, the others go on
                    piece = [(key, *[None] * len(names), f"{type(e).__name__}: {e}"[:200])]
                while piece is not None:
                    rows += piece
                    if len(rows) >= batch:
                        yield frame()
                        rows.clear()
                    piece = next(pieces, None)
        yield frame()

    return df.select(F.col(doc).cast("string").alias("doc"), F.col(column).alias("input")).mapInPandas(run, f"doc string, {schema}, {ERROR}")
