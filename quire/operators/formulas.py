"""Formulas that use what earlier formulas of their document define: definitions are read one formula at a time, use is followed in order or by joins.

A definition counts from the formula after the one that makes it. What a formula needs is a fixpoint: the definitions of
the names in it, of the names in those, and so on, always only those of earlier formulas. A document of few formulas is
gone through once, in order, with the definitions so far as the state. One of many is followed by joins, so that it meets in no
task: semi-naively, each round joins the names that the round before found first, so cycles end and the rounds are as many as the longest chain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quire.operators.ranges import dealt
from quire.operators.stored import stored

#: The most formulas of a document that one task goes through; of a longer document none is cut, it is followed by joins.
MOST_IN_ORDER = 1_000
#: How many rows or characters a task gives at a time.
BATCH_ROWS, BATCH_CHARS = 5_000, 4_000_000
#: Formulas that are remembered with their parts, as many repeat; longer texts than so many characters are not.
REMEMBERED, LONG = 4_096, 1_000
#: The commands that define, and what follows each.
DEFINERS = {
    **dict.fromkeys(("newcommand", "renewcommand", "providecommand"), "star name body option option group"), "DeclareMathOperator": "star name body group", "def": "macro body parameters group",
    "let": "macro body equals single", **dict.fromkeys(("newenvironment", "renewenvironment"), "environment body option option group group"), "DeclarePairedDelimiter": "name body argument argument",
}
_TOKEN = re.compile(r"(?P<command>\\(?:[A-Za-z]+|.))|(?P<comment>%[^\n]*)|(?P<space>\s+)|(?P<other>.)", re.S)
_BEGINS = re.compile(r"\\begin\s*\{([^{}]+)\}|\\(?:[A-Za-z]+|.)", re.S)
_COMMENT = re.compile(r"(\\.)|%[^\n]*", re.S)
_NAMES = ArrayType(StringType())
_DEFINITION = StructType([StructField("n", IntegerType()), StructField("name", StringType()), StructField("text", StringType()), StructField("uses", _NAMES)])
PARTS = StructType([StructField("names", _NAMES), StructField("definitions", ArrayType(_DEFINITION))])


def names_in(tex: str) -> list[str]:
    """The commands of a text and the environments that it begins, each once."""
    plain = _COMMENT.sub(lambda m: m[1] or "", tex)
    return list(dict.fromkeys(f"env:{m[1].strip()}" if m[1] else m[0] for m in _BEGINS.finditer(plain)))


class _Reader:
    """The tokens of a formula without comments, and where each brace closes."""

    def __init__(self, tex: str):
        self.tex = tex
        self.tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(tex) if m.lastgroup != "comment"]
        self.closes: dict[int, int] = {}
        opened = []
        for i, (_, s, _, _) in enumerate(self.tokens):
            if s == "{":
                opened.append(i)
            elif s == "}" and opened:
                self.closes[opened.pop()] = i

    def is_(self, i: int, text: str) -> bool:
        return i < len(self.tokens) and self.tokens[i][1] == text

    def command(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] == "command"

    def past_space(self, i: int) -> int:
        return i + 1 if i < len(self.tokens) and self.tokens[i][0] == "space" else i

    def part(self, kind: str, i: int) -> tuple[int | None, str]:
        """Where a part that begins at token i ends (None: it is not there), and the name that it gives."""
        if kind == "star":
            return (i + 1 if self.is_(i, "*") else i), ""
        if kind == "equals":
            return (i + 1 if self.is_(i, "=") else i), ""
        if kind == "macro" or kind in ("name", "argument") and self.command(i):
            return (i + 1, self.tokens[i][1]) if self.command(i) else (None, "")
        if kind == "group" or kind == "argument" and self.is_(i, "{"):
            return (self.closes[i] + 1 if i in self.closes else None), ""
        if kind == "argument":
            return (i + 1 if i < len(self.tokens) and not self.is_(i, "}") else None), ""
        if kind == "single":
            return (i + 1 if i < len(self.tokens) and self.tokens[i][1] not in "{}" else None), ""
        if kind == "parameters":
            while i < len(self.tokens) and self.tokens[i][1] not in ("{", "}"):
                i += 1
            return i, ""
        if kind == "option":
            if not self.is_(i, "["):
                return i, ""
            while i < len(self.tokens) and not self.is_(i, "]"):
                i = self.closes.get(i, len(self.tokens)) + 1 if self.is_(i, "{") else i + 1
            return (i + 1 if i < len(self.tokens) else None), ""
        if i not in self.closes:
            return None, ""
        end = self.closes[i]
        inner = self.tex[self.tokens[i][3] : self.tokens[end][2]].strip()
        right = r"\\(?:[A-Za-z]+|.)" if kind == "name" else r"[A-Za-z@*]+"
        return (end + 1, inner if kind == "name" else f"env:{inner}") if re.fullmatch(right, inner, re.S) else (None, "")

    def definitions(self) -> Iterator[tuple[int, str, str, list[str]]]:
        """(n, name, text, uses) of every definition that is whole."""
        i, n = 0, 0
        while i < len(self.tokens):
            kind, text, start, _ = self.tokens[i]
            i += 1
            if kind != "command" or text[1:] not in DEFINERS:
                continue
            at, name, body = i, "", i
            for part in DEFINERS[text[1:]].split():
                if part == "body":
                    body = at
                    continue
                at = at if part == "parameters" else self.past_space(at)
                at, given = self.part(part, at)
                if at is None:
                    break
                name = name or given
            if at is not None and name:
                end = self.tokens[at - 1][3]
                first = self.tokens[body][2] if body < len(self.tokens) else end
                yield n, name, self.tex[start:end], names_in(self.tex[first:end])
                i, n = at, n + 1


def _parts(tex: str) -> tuple[list[str], list[tuple[int, str, str, list[str]]]]:
    return names_in(tex), list(_Reader(tex).definitions())


_remembered = lru_cache(REMEMBERED)(_parts)


def parts(tex: str) -> tuple[list[str], list[tuple[int, str, str, list[str]]]]:
    """The names that a formula holds, and its definitions in order."""
    return (_remembered if len(tex) <= LONG else _parts)(tex)


@pandas_udf(PARTS)
def tex_parts(tex: pd.Series) -> pd.DataFrame:
    """parts() as columns."""
    rows = [(names, [dict(zip(("n", "name", "text", "uses"), d, strict=True)) for d in made]) for names, made in (parts(t or "") for t in tex)]
    return pd.DataFrame(rows, columns=["names", "definitions"])


class _Defined:
    """The definitions of a document so far."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.by_name: dict[str, list[int]] = {}
        self.uses: dict[str, set[str]] = {}

    def needed(self, names: set[str]) -> list[int]:
        """The numbers, in order, of the definitions of names, of the names in those, and so on."""
        found = {name for name in names if name in self.by_name}
        new = list(found)
        while new:
            for name in self.uses[new.pop()]:
                if name in self.by_name and name not in found:
                    found.add(name)
                    new.append(name)
        return sorted(k for name in found for k in self.by_name[name])

    def add(self, made: list[tuple[int, str, str, list[str]]]) -> None:
        for _, name, text, uses in sorted(made, key=lambda d: (d[0], d[2])):
            self.by_name.setdefault(name, []).append(len(self.texts))
            self.uses.setdefault(name, set()).update(uses)
            self.texts.append(text)


def _gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """carried() of rows (doc, pos, tex) sorted by doc and pos, with each document's rows in one task."""
    rows, size, schema = [], 0, None

    def given() -> pa.RecordBatch:
        kinds = [*schema.types[:2], pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc", "pos", "n_carried", "drawn"])

    def each() -> Iterator[tuple]:
        nonlocal schema
        for batch in batches:
            schema = batch.schema
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    for doc, formulas in groupby(each(), lambda row: row[0]):
        defined = _Defined()
        for pos, here in groupby(formulas, lambda row: row[1]):
            texts = [row[2] for row in here]
            read = [parts(tex) for tex in texts]
            known = doc is not None and pos is not None
            needed = defined.needed({name for names, _ in read for name in names}) if known and defined.texts else []
            before = "".join(defined.texts[k] for k in needed)
            for tex in texts:
                rows.append((doc, pos, len(needed), before + tex))
                size += len(before) + len(tex)
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield given()
                    rows, size = [], 0
            if known:
                defined.add([d for _, made in read for d in made])
    if rows:
        yield given()


def carried(formulas: DataFrame, tex: Column | str = "tex", most: int = MOST_IN_ORDER) -> DataFrame:
    """(doc, pos, n_carried, drawn) of formulas (doc, pos, tex): each formula behind the earlier definitions that it needs, in order.

    A null formula is an empty one; formulas of one doc and pos are not earlier than each other. Documents of more than `most` formulas are followed by joins.
    """
    given = formulas.select("doc", "pos", F.coalesce(tex if isinstance(tex, Column) else F.col(tex), F.lit("")).alias("tex"))
    long = stored(given.groupBy("doc").count().where(F.col("count") > most).select("doc"))
    if not long.limit(1).count():
        return _in_order(given)
    # A formula without a document has none before it, by either way.
    return _in_order(given.join(long, "doc", "left_anti")).unionByName(_by_joins(given.join(long, "doc", "left_semi")))


def _in_order(formulas: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in formulas.schema}
    schema = StructType([StructField("doc", kinds["doc"]), StructField("pos", kinds["pos"]), StructField("n_carried", IntegerType()), StructField("drawn", StringType())])
    # Formulas without a document are many tasks' work.
    return dealt(formulas, "doc", F.when(F.col("doc").isNull(), F.hash("tex"))).sortWithinPartitions("doc", "pos").mapInArrow(_gone_through, schema)


def _by_joins(formulas: DataFrame) -> DataFrame:
    read = stored(formulas.withColumn("parts", tex_parts("tex")))
    made = read.select("doc", F.col("pos").alias("made"), F.explode("parts.definitions").alias("d")).select("doc", "made", "d.*")
    made = stored(made)
    defined = made.select("doc", "name").distinct()
    new = stored(read.select("doc", "pos", F.explode(F.array_distinct("parts.names")).alias("name")).distinct().join(defined, ["doc", "name"], "left_semi"))
    rounds = [new]
    uses = made.select("doc", "made", "name", F.explode("uses").alias("use")).join(defined.withColumnRenamed("name", "use"), ["doc", "use"], "left_semi")
    while new.limit(1).count():
        found = new.join(uses, ["doc", "name"]).where("made < pos").select("doc", "pos", F.col("use").alias("name")).distinct()
        for old in rounds:
            found = found.join(old, ["doc", "pos", "name"], "left_anti")
        new = stored(found)
        rounds.append(new)
        if len(rounds) > 8:
            rounds = [stored(_united(rounds))]
    taken = _united(rounds).distinct().join(made, ["doc", "name"]).where("made < pos")
    before = taken.groupBy("doc", "pos").agg(F.array_sort(F.collect_list(F.struct("made", "n", "text"))).alias("before"))
    joined = read.join(before, ["doc", "pos"], "left")
    return joined.select("doc", "pos", F.coalesce(F.size("before"), F.lit(0)).alias("n_carried"), F.concat(F.coalesce(F.array_join("before.text", ""), F.lit("")), "tex").alias("drawn"))


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
