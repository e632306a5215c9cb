"""JSON as it is written: re-indenting, depth, records and broken input."""

import pytest
from pyspark.sql import functions as F

from quire.operators import jsontext


def texts(spark, *values):
    return spark.createDataFrame([(str(k), v) for k, v in enumerate(values)], "doc string, text string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":12345678901234567890,"b":1.0,"a":[]}', '{\n  "a": 12345678901234567890,\n  "b": 1.0,\n  "a": []\n}'),
        ("[1,// one\n2]", "[\n  1,\n  // one\n  2\n]"),
        ("[ ]", "[]"),
        ("[{ }]", "[\n  {}\n]"),
        ("[1,]", "[\n  1,\n]"),
        ("{'k': 'it''s'}", None),
        ("{'k': 'it\\'s'}", "{\n  'k': 'it\\'s'\n}"),
        ("tru e", None),
        ("[1}", None),
        ("]", None),
        ("[", None),
        ('["open', None),
        ("", ""),
        ("[1 /* x */]", "[\n  1/* x */\n]"),
    ],
)
def test_reindented(spark, text, want):
    (row,) = jsontext.reindented(texts(spark, text, None)).collect()
    assert row.json == want


def test_deep(spark):
    text = "[" * 10_000 + "]" * 10_000
    (row,) = jsontext.reindented(texts(spark, text)).collect()
    assert "".join(row.json.split()) == text and max(map(len, row.json.split("\n"))) == 2 * jsontext.MOST_INDENT + 2
    (field,) = jsontext.fields(texts(spark, '{"a": ' + text + "}"), lines=True).collect()
    assert (field.value, field.nested) == (text, 1)


def test_bad_lines_cost_no_other_record(spark):
    rows = jsontext.records(texts(spark, '﻿{"a":1}\nnope\n\n{"a":' + "[" * 3000 + '\r\n{"a":2,"b":" "}\n{"a":1}{"a":2}\n{}'), lines=True).orderBy("row_no").collect()
    assert [(r.row_no, r.fields, r.error is None) for r in rows] == [
        (0, {"a": "1", "b": ""}, True), (1, None, False), (3, None, False), (4, {"a": "2", "b": " "}, True), (5, None, False), (6, {"a": "", "b": ""}, True),
    ]


def test_arrays(spark):
    rows = jsontext.records(texts(spark, '[{"a": {"x" : [1]}, "b": 1}]', '[{"a": 1}, 2]', "[{}]", "3", '"s"')).orderBy("doc").collect()
    assert [(r.doc, r.error is None, r.fields) for r in rows] == [("1", False, None), ("2", True, {})]


def test_texts_are_laid_out_without_a_shuffle(spark):
    """Tokens of a text stand in one row of it; moving them moves many times the input."""
    df = texts(spark, "[1]")
    for made in (jsontext.reindented(df), jsontext.nesting(df), jsontext.are_records(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_nesting_is_that_of_the_tokens(spark):
    df = texts(spark, '{"a":[1,{}]} // c', "][", "][]", "[}", "{]{}", "}{[[]", " ", "[[[")
    t = jsontext.nested(jsontext.tokens(df))
    want = t.groupBy("doc").agg(F.max("depth").cast("long"), F.count("*"), F.count_if(F.col("partner").isNotNull())).orderBy("doc").collect()
    assert [tuple(r) for r in jsontext.nesting(df).drop("error").orderBy("doc").collect()] == [tuple(r) for r in want]


def test_lines_that_are_rows(spark):
    df = spark.createDataFrame([("a:b", 7, '{"x":1,"x":2}'), ("a:b", 9, "{"), ("a:b", 12, '{"y":3}'), (None, 1, '{"z":1}')], "doc string, n long, text string")
    rows = jsontext.records(df, line_no="n").where("doc is not null").orderBy("row_no").collect()
    assert [(r.doc, r.row_no, r.fields, r.error is None) for r in rows] == [("a:b", 7, {"x": "2", "y": ""}, True), ("a:b", 9, None, False), ("a:b", 12, {"x": "", "y": "3"}, True)]
