"""JSON read as it is written: tokens as rows, nesting by running sums, texts laid out where they stand, records by joins. Nothing is parsed into values, so no number changes.

Strings, numbers and literals are copied; comments and single-quoted strings are tokens too. Nesting is a column, whatever its depth:
no step calls itself for what is inside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.stored import stored
from quire.sources.common import parsed

MOST_INDENT = 40
_TOKEN = re.compile(r"""(?P<space>[ \n\r\t﻿]+)|(?P<open>[{\[])|(?P<close>[}\]])|(?P<colon>:)|(?P<comma>,)|(?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<value>[^ \n\r\t{}\[\]:,"'/]+)""", re.S)


_LITERAL = r"true|false|null|-?[0-9][0-9.eE+-]*"


def lexed(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of every token but white space; JSONDecodeError where none can begin."""
    at = 0
    for m in iter(_TOKEN.scanner(text).match, None):
        at = m.end()
        if m.lastgroup != "space":
            yield m.lastgroup, m[0].rstrip() if m[0].startswith("//") else m[0]
    if at < len(text):
        raise json.JSONDecodeError("no token begins here", text, at)


def tokens(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, pos, kind, token, error): kinds are open, close, colon, comma, string, value and comment; a text that is none has one row with its error."""
    return parsed(df, column, "pos int, kind string, token string", lambda t: ((k, *x) for k, x in enumerate(lexed(t))), doc=doc)


def nested(tokens: DataFrame) -> DataFrame:
    """tokens with depth (how many brackets are open around a token) and partner (pos of the bracket that closes it, or that it closes; null where they do not match)."""
    order = Window.partitionBy("doc").orderBy("pos")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    deep = tokens.withColumn("_open", F.sum(step).over(order)).withColumn("depth", (F.col("_open") - F.greatest(step, F.lit(0))).cast("int"))
    bracket = F.col("kind").isin("open", "close")
    level = Window.partitionBy("doc", "depth", bracket).orderBy("pos")
    fits = lambda a, b: ((a == "{") & (b == "}")) | ((a == "[") & (b == "]"))
    closed = F.when(fits(F.col("token"), F.lead("token").over(level)), F.lead("pos").over(level))
    closes = F.when(fits(F.lag("token").over(level), F.col("token")), F.lag("pos").over(level))
    return deep.withColumn("partner", F.when(F.col("kind") == "open", closed).when(F.col("kind") == "close", closes)).drop("_open")


_PAIRS = {"}": "{", "]": "["}


def _nesting(text: str) -> Iterator[tuple[int, int, int]]:
    """The greatest depth of a text's tokens, their number, and how many are brackets with a partner, as nested() has them; no row without tokens."""
    depth, n, matched, deepest = 0, 0, 0, None
    last: dict[int, str] = {}  # the last bracket of each depth
    for kind, token in lexed(text):
        n += 1
        at = depth
        if kind == "open":
            last[depth] = token
            depth += 1
        elif kind == "close":
            at = depth = depth - 1
            matched += 2 * (last.get(depth) == _PAIRS[token])
            last[depth] = token
        deepest = at if deepest is None or at > deepest else deepest
    if n:
        yield deepest, n, matched


def nesting(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, deepest, tokens, matched, error): nested() summed up for each text, whose tokens never become rows."""
    return parsed(df, column, "deepest long, tokens long, matched long", _nesting, doc=doc)


def _laid_out(text: str) -> str | None:
    """A text with two spaces for each level, read token by token; None where brackets do not match or two values follow each other."""
    pad = lambda depth: "\n" + "  " * min(depth, MOST_INDENT)
    parts, opened, before = [], [], None
    steps = lexed(text)
    step, after = next(steps, None), next(steps, None)
    while step:
        kind, token = step
        # The token before, passing over comments, decides whether a value may stand here.
        if kind in ("open", "string", "value") and before in ("close", "string", "value"):
            return None
        if kind == "open" and after and after[0] == "close":
            if _PAIRS[after[1]] != token:
                return None
            parts.append(token + after[1])
            kind, after = "close", next(steps, None)
        elif kind == "close":
            if not opened or opened.pop() != _PAIRS[token]:
                return None
            parts.append(pad(len(opened)) + token)
        elif kind == "colon":
            parts.append(": ")
        elif kind in ("open", "comma", "comment"):
            if kind == "open":
                opened.append(token)
            parts.append(token if after and after[0] == "close" else token + pad(len(opened)))
        else:
            parts.append(token)
        before = before if kind == "comment" else kind
        step, after = after, next(steps, None)
    return None if opened else re.sub(r"[ \t]+\n", "\n", "".join(parts)).rstrip(" \t\n\r")


def reindented(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, json): each text with two spaces for each level (40 levels at most), tokens as written and comments in place.

    Null where brackets do not match or two values follow each other, so that a caller keeps the original. Empty text is empty.
    A text is laid out where it stands: its tokens, many times its size as rows, are not shuffled."""
    return parsed(df, column, "json string", lambda t: [(_laid_out(t),)], doc=doc).select("doc", "json")


def shown(token: str) -> str:
    """A string token's text, without its quotes."""
    if token.startswith('"'):
        try:
            return json.loads(token)
        except ValueError:
            pass
    return token[1:-1]


def fields_of(text: str, array: bool) -> Iterator[tuple[int, int, str | None, str | None, int]]:
    """(row, n, key, value, nested) of every field of an array of objects, or of one object; a row without fields has one with a null key.

    A nested value is its tokens without space. A text that is another JSON value than an array has no field; JSONDecodeError where
    it is none, or an array of something else."""
    if array and re.match(rf"\s*(?:[{{\"]|(?:{_LITERAL})\s*$)", text.lstrip("\ufeff")):
        return
    steps = ((k, t) for k, t in lexed(text) if k != "comment")

    def need(*wanted: str) -> tuple[str, str]:
        kind, token = next(steps, ("end", ""))
        if kind not in wanted and token not in wanted:
            raise json.JSONDecodeError(f"{token[:20] or kind} where {' or '.join(wanted)} should be", "", 0)
        return kind, token

    row = 0
    more = not array or need("[") and True
    while more:
        if need("{", "]" if array and row == 0 else "{")[1] == "]":
            break
        n, token = 0, need("string", "}")[1]
        while token != "}":
            key = shown(token)
            need("colon")
            kind, value = need("string", "value", "open")
            if kind == "open":
                parts, depth = [value], 1
                while depth:
                    kind, token = next(steps, ("end", ""))
                    if kind == "end":
                        raise json.JSONDecodeError("a bracket is never closed", "", 0)
                    depth += (kind == "open") - (kind == "close")
                    parts.append(token)
                yield row, n, key, "".join(parts), 1
            else:
                yield row, n, key, shown(value) if kind == "string" else "" if value == "null" else value, 0
            n += 1
            token = need("comma", "}")[1]
            if token == ",":
                token = need("string")[1]
        if not n:
            yield row, 0, None, None, 0
        row += 1
        more = array and need("comma", "]")[1] == ","
    if next(steps, None):
        raise json.JSONDecodeError("text behind the end", "", 0)


FIELD = "row_no long, n int, key string, value string, nested int"
RECORD = "row_no long, keys array<string>, values array<string>, fields long, nested long"


def _records(text: str, array: bool) -> Iterator[tuple[int, list[str], list[str], int, int]]:
    """(row, keys, values, fields, nested) of every object: keys in the order in which they are first seen, each with its last value, and how many fields and nested values there are."""
    for row, found in groupby(fields_of(text, array), key=lambda f: f[0]):
        given, n, nested = {}, 0, 0
        for _, _, key, value, deep in found:
            if key is not None:
                given[key] = value
                n, nested = n + 1, nested + deep
        yield row, list(given), list(given.values()), n, nested


def _counts(text: str, array: bool) -> Iterator[tuple[int, int, int]]:
    """(objects, fields, nested) of a text."""
    objects, n, nested, last = 0, 0, 0, -1
    for row, _, key, _, deep in fields_of(text, array):
        objects, last = objects + (row != last), row
        n, nested = n + (key is not None), nested + deep
    yield objects, n, nested


def _by_line(df: DataFrame, column: str, doc: str, line_no: str | None, schema: str, parse: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """(doc, line_no, <schema>, error) of the filled lines of texts, or of rows that are lines already."""
    name = F.col(doc).cast("string").alias("name")
    if line_no is None:
        split = df.select(name, F.posexplode(F.split(F.regexp_replace(column, "^\ufeff", ""), "\n")).alias("line_no", "line"))
    else:
        split = df.select(name, F.col(line_no).alias("line_no"), F.regexp_replace(column, "^\ufeff", "").alias("line"))
    at = F.concat(F.col("line_no").cast("string"), F.coalesce(F.concat(F.lit(":"), "name"), F.lit("")))
    filled = split.where(F.col("line").rlike(r"[^ \t\n\x0B\f\r]")).select(at.alias("at"), "line")
    read = parsed(filled, "line", schema, parse, doc="at")
    place = F.instr("doc", ":")
    names = [x.split()[0] for x in schema.split(", ") if x != "row_no long"]
    own = F.when(place > 0, F.substring("doc", place + 1, F.length("doc")))
    return read.select(own.alias("doc"), F.substring_index("doc", ":", 1).cast("long").alias("row_no"), *names, "error")


def fields(df: DataFrame, column: str = "text", doc: str = "doc", *, lines: bool = False) -> DataFrame:
    """(doc, row_no, n, key, value, nested, error): the fields of an array of objects, or of the object on every filled line.

    A line that is no object is a row with its error and the line's number; the other lines stay. Lines are rows before they are
    read, so they need not be read together. An array that breaks somewhere is one error."""
    if not lines:
        return parsed(df, column, FIELD, lambda t: fields_of(t, True), doc=doc)
    return _by_line(df, column, doc, None, FIELD, lambda t: fields_of(t, False))


def records(df: DataFrame, column: str = "text", doc: str = "doc", *, lines: bool = False, line_no: str | None = None) -> DataFrame:
    """(doc, row_no, fields, header, error): records of text documents whose values are scalars, but for a tenth of them at most.

    header is the keys in the order in which they are first seen; a missing field is empty, of a repeated key the last counts.
    Documents with too many nested values, and empty arrays, have no rows; an error is a row of its own, without fields. line_no:
    the column with the number of a line, where rows of df are lines of their documents."""
    if lines or line_no is not None:
        found = stored(_by_line(df, column, doc, line_no, RECORD, lambda t: _records(t, False)))
    else:
        found = stored(parsed(df, column, RECORD, lambda t: _records(t, True), doc=doc))
    good = found.where("error is null")
    # Records of a document have few different lists of keys, so what is known of a document is found from those.
    kinds = good.groupBy("doc", "keys").agg(F.min("row_no").alias("row_no"), F.sum("fields").alias("all"), F.sum("nested").alias("deep"))
    share = kinds.groupBy("doc").agg(F.sum("all").alias("all"), F.sum("deep").alias("deep")).where("deep * 10 <= all").select("doc")
    keys = kinds.select("doc", "row_no", F.posexplode("keys").alias("n", "key")).groupBy("doc", "key").agg(F.min(F.struct("row_no", "n")).alias("first"))
    header = keys.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "key")))["key"].alias("header"))
    known = share.join(header, "doc", "left").withColumn("header", F.coalesce("header", F.array().cast("array<string>")))
    given = F.map_from_arrays("keys", "values")
    filled = F.map_from_arrays("header", F.transform("header", lambda k: F.coalesce(F.try_element_at(given, k), F.lit(""))))
    full = good.join(known, "doc").select("doc", "row_no", F.when(F.col("keys") == F.col("header"), given).otherwise(filled).alias("fields"), "header", F.lit(None).cast("string").alias("error"))
    wrong = found.where("error is not null").select("doc", "row_no", F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast("array<string>").alias("header"), "error")
    return full.unionByName(wrong)


def nested_share(fields: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, fields, nested, is_table): how many fields there are, how many values are arrays or objects, and whether these are a tenth at most."""
    counted = fields.groupBy(*keys).agg(F.count("*").alias("fields"), F.sum(F.col(value).rlike(r"^\s*[\[{]").cast("int")).alias("nested"))
    return counted.withColumn("is_table", F.col("nested") * 10 <= F.col("fields"))


def are_records(df: DataFrame, column: str = "text", doc: str = "doc", *, lines: bool = False) -> DataFrame:
    """(doc, is_table): whether a text is records: objects, at least one, of which a tenth of the values at most are nested, and nothing else. Null texts have no row."""
    counts = "objects long, fields long, nested long"
    if not lines:
        one = parsed(df, column, counts, lambda t: _counts(t, True), doc=doc)
        return one.select("doc", F.coalesce(F.col("error").isNull() & (F.col("objects") > 0) & (F.col("nested") * 10 <= F.col("fields")), F.lit(False)).alias("is_table"))
    found = _by_line(df, column, doc, None, counts, lambda t: _counts(t, False))
    judged = found.groupBy("doc").agg((F.count("error") == 0).alias("whole"), (F.sum("nested") * 10 <= F.sum("fields")).alias("flat"))
    every = df.where(F.col(column).isNotNull()).select(F.col(doc).cast("string").alias("doc"))
    return every.join(judged, "doc", "left").select("doc", F.coalesce(F.col("whole") & F.col("flat"), F.lit(False)).alias("is_table"))
