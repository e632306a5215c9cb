"""Tables from positioned text: items (doc, page, text, x0, x1, y, height) to cells.

The rules that look back at a running anchor or mean are no window frames, so a page is one group of applyInPandas:
a page's items are a bounded number. What comes before and after (confidence, folding, scoring) is relational.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.cells import folded
from quire.operators.stored import stored


@dataclass(frozen=True)
class GridRules:
    min_rows: int = 3
    min_columns: int = 2
    tolerance: float = 2.5
    min_confidence: float = 0.6


def _upper_median(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else 0.0


def _lines(y: np.ndarray, height: np.ndarray) -> np.ndarray:
    """A line number for each item in order of y: a new line where y leaves the line's first item by over half a line height."""
    tall = _upper_median(height[height > 0])
    if not tall:
        gaps = np.diff(np.unique(y))
        tall = _upper_median(gaps[gaps > 0]) or 10.0
    line, anchor, out = 0, y[0], np.zeros(len(y), int)
    for k, v in enumerate(y):
        if abs(v - anchor) > tall / 2:
            line, anchor = line + 1, v
        out[k] = line
    return out


def _columns(x: np.ndarray, n_lines: int, tolerance: float) -> np.ndarray:
    """Left edges that at least two items, and a quarter as many as there are lines, share."""
    centres: list[list[float]] = []
    for v in np.sort(x):
        if centres and abs(v - centres[-1][0]) <= tolerance:
            mean, n = centres[-1]
            centres[-1] = [(mean * n + v) / (n + 1), n + 1]
        else:
            centres.append([float(v), 1])
    return np.array([m for m, n in centres if n >= max(2, -(-n_lines // 4))])


def column_origins(items: DataFrame, tolerance: float) -> DataFrame:
    """(doc, page, origins): the left edges of the columns of each page of items, from left to right."""

    def page(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x0"], kind="stable")
        line = _lines(part["y"].to_numpy(), part["height"].fillna(0).to_numpy())
        found = np.sort(_columns(part["x0"].to_numpy(), line[-1] + 1, tolerance))
        return pd.DataFrame({"doc": [str(part["doc"].iloc[0])], "page": [int(part["page"].iloc[0])], "origins": [found.tolist()]})

    return items.select("doc", "page", "x0", "y", "height").groupBy("doc", "page").applyInPandas(page, "doc string, page int, origins array<double>")


def infer_cells(items: DataFrame, rules: GridRules | None = None, *, fold: bool = True) -> DataFrame:
    """(doc, table_no, r, c, value) with table_no the page, of pages whose items form a grid; in reading order downwards."""
    rules = rules or GridRules()

    def page(part: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"doc": [], "table_no": [], "r": [], "c": [], "value": []}, dtype=object)
        part = part[part["text"].str.strip() != ""].sort_values(["y", "x0"], kind="stable")
        if part.empty:
            return none
        line = _lines(part["y"].to_numpy(), part["height"].fillna(0).to_numpy())
        columns = _columns(part["x0"].to_numpy(), line[-1] + 1, rules.tolerance)
        if line[-1] + 1 < rules.min_rows or len(columns) < rules.min_columns:
            return none
        away = part["x0"].to_numpy()[:, None] - columns[None, :]
        score = np.where(away >= -rules.tolerance, away, np.abs(away) * 4)  # a column further right is a worse home
        placed = part.assign(r=line, c=score.argmin(axis=1)).sort_values(["r", "c", "x0"], kind="stable")
        text = placed.groupby(["r", "c"])["text"].agg(lambda t: " ".join(" ".join(t).split()))
        grid = text.reindex(pd.MultiIndex.from_product([range(line[-1] + 1), range(len(columns))], names=["r", "c"]), fill_value="").reset_index(name="value")
        values = grid["value"].tolist()
        return pd.DataFrame({"doc": [str(part["doc"].iloc[0])] * len(values), "table_no": int(part["page"].iloc[0]), "r": grid["r"].tolist(), "c": grid["c"].tolist(), "value": values}, dtype=object)

    # Both are read several times below, and pages are not to be laid out each time.
    raw = stored(items.select("doc", "page", "text", "x0", "y", "height").groupBy("doc", "page").applyInPandas(page, "doc string, table_no int, r int, c int, value string"))
    grid = stored(folded(raw)) if fold else raw
    filled = grid.groupBy("doc", "table_no", "r").agg(F.sum((F.col("value") != "").cast("int")).alias("filled"))
    good = filled.groupBy("doc", "table_no").agg(F.avg((F.col("filled") >= 2).cast("int")).alias("confidence"), F.count("*").alias("rows")).where((F.col("confidence") >= rules.min_confidence) & (F.col("rows") >= rules.min_rows))
    used = grid.where("value <> ''").groupBy("doc", "table_no").agg((F.max("c") + 1).alias("width")).where(F.col("width") >= rules.min_columns)
    return grid.join(good, ["doc", "table_no"], "left_semi").join(used, ["doc", "table_no"]).where("c < width").drop("width")


def mean_confidence(words: DataFrame, keys: list[str], word: str = "text", confidence: str = "confidence", least: float = 70.0) -> DataFrame:
    """(keys, mean, n, readable): the mean confidence of the recognised words that are not blank, and whether it is high enough to be read."""
    found = words.where(F.trim(word) != "").groupBy(*keys).agg(F.avg(confidence).alias("mean"), F.count("*").alias("n"))
    return found.withColumn("readable", F.col("mean") >= least)


def grid_from_words(words: DataFrame, least: float = 70.0) -> DataFrame:
    """Cells of pages of recognised words (with confidence) whose mean confidence is at least `least`."""
    sure = mean_confidence(words, ["doc", "page"], least=least).where("readable")
    tolerance = 4.0
    return infer_cells(words.join(sure, ["doc", "page"], "left_semi"), GridRules(tolerance=tolerance))
