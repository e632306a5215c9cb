"""XML laid out again, elements by name, references and outlines."""

import pytest
from pyspark.sql import functions as F

from quire.operators import markup


def texts(spark, *values):
    return spark.createDataFrame([(str(k), v) for k, v in enumerate(values)], "doc string, text string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<a><b/><c>x</c></a>", "<a>\n  <b/>\n  <c>x</c>\n</a>"),
        ("<p>Some <b>bold</b> text</p>", "<p>Some <b>bold</b> text</p>"),
        ("<a><p>x<b><c/></b></p><d><e/></d></a>", "<a>\n  <p>x<b><c/></b></p>\n  <d>\n    <e/>\n  </d>\n</a>"),
        ('<a xml:space="preserve"> <b/> </a>', '<a xml:space="preserve"> <b/> </a>'),
        ("<a></a>", "<a></a>"),
        ("<a></b>", None),
        ("<a>", None),
        ("</a>", None),
        ("</a><a>", None),
        ("<a/>text", None),
        ("<a><![CDATA[x]]><b/></a>", "<a><![CDATA[x]]><b/></a>"),
        ("<a><b></a></b>", None),
        ("", ""),
    ],
)
def test_reindented(spark, text, want):
    assert [r.xml for r in markup.reindented(texts(spark, text)).collect()] == [want]


def test_deep(spark):
    (row,) = markup.reindented(texts(spark, "<a>" * 300 + "<b/>" + "</a>" * 300)).collect()
    assert row.xml.count("\n") == 600 and row.xml.split("\n")[300] == "  " * 300 + "<b/>"


def test_elements(spark):
    got = markup.elements(texts(spark, "<t><t>1</t></t><u><t a='x'/></u><t>open <u>", "none"), ["t"]).orderBy("pos").collect()
    assert [(r.name, r.inner) for r in got] == [("t", "<t>1</t>"), ("t", ""), ("t", "open <u>")]


def test_decoded_and_attributes(spark):
    row = texts(spark, "&lt;&#65;&#x1F600;&amp;lt; & &#; &apos;").select(markup.decoded(F.col("text")).alias("d")).first()
    assert row.d == "<A\U0001f600&lt; & &#; '"
    tag = texts(spark, "<x atext=\"no\" b='text=\"no\"' text = 'yes' z=\"\"/>").select(markup.attribute(F.col("text"), "text").alias("t"), markup.attribute(F.col("text"), "z").alias("z"), markup.attribute(F.col("text"), "q").alias("q")).first()
    assert tuple(tag) == ("yes", "", None)


def test_outlines(spark):
    deep = "<opml>" + '<outline text="d">' * 2000 + "</outline>" * 2000 + "</opml>"
    rows = markup.outlines(texts(spark, '<opml><body><outline/><outline title="a&#10;b"><outline text="c" url="javascript:x" xmlUrl="https://f"/></outline></body></opml>', "<x><outline text='no'/></x>", deep)).orderBy("doc", "n").collect()
    assert [tuple(r)[1:] for r in rows[:3]] == [(None, 0, None, 1, "", None, None), (None, 1, None, 1, "a\nb", None, None), (None, 2, 1, 2, "c", "https://f", None)]
    assert len(rows) == 2003 and rows[-1].depth == 2000 and rows[-1].parent == 1998


def test_texts_are_read_without_a_shuffle(spark):
    df = texts(spark, "<a/>")
    for made in (markup.reindented(df), markup.elements(df, ["a"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    assert [r.xml for r in markup.reindented(texts(spark, None, " ", "<a/><![CDATA[x]]><?b?>")).collect()] == ["", "", "<a/>\n<![CDATA[x]]>\n<?b?>"]


def test_elements_with_stray_ends(spark):
    got = markup.elements(texts(spark, "</t><t>1</t></t><t>2<u></t><v>3</v><t/>"), ["t", "v"]).orderBy("pos").collect()
    assert [(r.pos, r.name, r.inner) for r in got] == [(1, "t", "1"), (5, "t", "2<u>"), (9, "v", "3"), (12, "t", "")]
