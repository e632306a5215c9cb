"""Long tables cut for printing: greedy chunks under a budget of rows and of cells, over blocks of rows.

A row goes into the chunk while the sums from the chunk's begin stay within both budgets; the first row of a table also goes
in while anything of both is left. So where a chunk that begins at a row would end is the first row whose sum passes a bound,
and it is at most one row more than the budget of rows away. Rows are numbered and cut into blocks of BLOCK times that reach;
a block, with the reach of rows behind it, says for each row that a chunk from the block before can lead to (its first ones)
where the path from there enters the next block. These entries, a small share of the rows, are followed from the first row of
a document by jumps of 1, 2, 4, ... blocks. Each block then knows its one entry and walks its rows once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ranges import dealt, running
from quire.operators.stored import stored

#: What one print takes, and how many times as long as a chunk a block of rows is.
MOST_ROWS, MOST_CELLS = 1500, 60_000
BLOCK = 128


def _ends(rows: pd.DataFrame, most_rows: int, most_cells: int) -> np.ndarray:
    """For each of some rows in order the place, from 0, of the first row that a chunk beginning there leaves out."""
    first = np.r_[False, rows["table_no"].to_numpy()[1:] != rows["table_no"].to_numpy()[:-1]]

    def passes(sizes: np.ndarray, most: int) -> np.ndarray:
        to = np.cumsum(sizes)
        return np.searchsorted(np.where(first, to - sizes + 1, to), to - sizes + most, side="right")

    # A row too large meets itself.
    return np.maximum(np.minimum(passes(rows["n_rows"].to_numpy(), most_rows), passes(rows["n_cells"].to_numpy(), most_cells)), np.arange(len(rows)) + 1)


def print_chunks(rows: DataFrame, most_rows: int = MOST_ROWS, most_cells: int = MOST_CELLS) -> DataFrame:
    """rows (doc, table_no, r, n_rows, n_cells) with chunk, from 0 in each doc.

    n_rows and n_cells are what a body row prints, itself and tables inside it; less than one counts as one. A row
    that alone passes a budget is a chunk's first. (doc, table_no, r) names a row."""
    order = [F.col("table_no"), F.col("r")]
    reach, length = most_rows + 1, BLOCK * (most_rows + 1)
    sized = rows.select("doc", "table_no", "r", F.greatest("n_rows", F.lit(1)).cast("long").alias("n_rows"), F.greatest("n_cells", F.lit(1)).cast("long").alias("n_cells"))
    placed = running(sized.withColumn("one", F.lit(1).cast("long")), order, ["doc"], sums={"p": "one"}).drop("one")
    summed = stored(placed.withColumn("p", F.col("p") - 1).withColumn("block", F.floor(F.col("p") / length)))

    def entries(part: pd.DataFrame) -> pd.DataFrame:
        """Where the chunks that begin at a block's first rows lead, as places of the document; no further than its last row."""
        part = part.sort_values("p", ignore_index=True)
        begin, own = int(part["p"].iloc[0]), int((part["block"] == part["at"]).sum())
        to = _ends(part, most_rows, most_cells)
        for i in range(own - 1, -1, -1):  # what a chunk leads to is known before it
            if to[i] < own:
                to[i] = to[to[i]]
        n = min(reach, own)
        found = pd.DataFrame({"doc": part["doc"].iloc[:n], "p": begin + np.arange(n), "next": begin + to[:n]})
        return found[to[:n] < len(part)]

    # The first rows of a block also stand behind the block before.
    ahead = (F.col("p") % length < reach) & (F.col("block") > 0)
    both = summed.withColumn("at", F.explode(F.when(ahead, F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))))
    doc = rows.schema["doc"].dataType.simpleString()
    jump = stored(dealt(both.select("doc", "at", "block", "p", "table_no", "n_rows", "n_cells"), "doc", "at").groupBy("doc", "at").applyInPandas(entries, f"doc {doc}, p long, next long"))
    begins = stored(summed.where("p = 0").select("doc", "p"))
    while jump.limit(1).count():
        begins = stored(begins.unionByName(begins.join(jump, ["doc", "p"]).select("doc", F.col("next").alias("p"))))
        jump = stored(jump.join(jump.select("doc", F.col("p").alias("next"), F.col("next").alias("then")), ["doc", "next"]).select("doc", "p", F.col("then").alias("next")))
    entered = begins.distinct().select("doc", F.floor(F.col("p") / length).alias("block"), F.col("p").alias("entry"))

    def walked(part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        """A block's rows with nth, how many chunks have begun in it."""
        part = part.sort_values("p", ignore_index=True)
        to, begun = _ends(part, most_rows, most_cells), np.zeros(len(part), "int64")
        i = int(entry["entry"].iloc[0] - part["p"].iloc[0]) if len(entry) else len(part)
        while i < len(part):
            begun[i], i = 1, to[i]
        return part.assign(nth=begun.cumsum())[["doc", "block", "table_no", "r", "n_rows", "n_cells", "nth"]]

    types = {f.name: f.dataType.simpleString() for f in summed.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ("doc", "block", "table_no", "r", "n_rows", "n_cells")) + ", nth long"
    cut = stored(dealt(summed, "doc", "block").groupBy("doc", "block").cogroup(dealt(entered, "doc", "block").groupBy("doc", "block")).applyInPandas(walked, schema))
    earlier = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("doc", "block").agg(F.max("nth").alias("n")).select("doc", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return cut.join(before, ["doc", "block"]).select("doc", "table_no", "r", "n_rows", "n_cells", (F.col("before") + F.col("nth") - 1).alias("chunk"))
