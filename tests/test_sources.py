"""Readers and writers on small documents of their own."""

import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import cells as C
from quire.operators import export, geometry
from quire.sources import files, html, records

PAGE = """<h1>Top &amp; all</h1><p>One<br>two<p>three <table><tr><th>Code<th>Name</tr><tr><td rowspan=2>a<td>first</tr><tr><td>second</tr><tr><td colspan=2>end</table>
<ul><li>x<li>y</ul><table><tr><td> </td></tr></table><hr><script>no</script>last"""


def docs(spark, *texts, name="text"):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], f"doc string, {name} {'binary' if isinstance(texts[0], bytes) else 'string'}")


def test_blocks(spark):
    got = [(r.tag, r.level, r.text) for r in html.blocks(docs(spark, PAGE, None, name="html")).orderBy("pos").collect()]
    assert got == [("h1", 1, "Top & all"), ("p", 0, "One two"), ("p", 0, "three"), ("li", 1, "x"), ("li", 1, "y"), ("hr", 0, ""), ("p", 0, "last")]


def test_cells(spark):
    rows = html.cells(docs(spark, PAGE, name="html")).orderBy("r", "c").collect()
    assert {r.table_no for r in rows} == {0}
    assert [(r.r, r.c, r.value) for r in rows] == [(0, 0, "Code"), (0, 1, "Name"), (1, 0, "a"), (1, 1, "first"), (2, 0, "a"), (2, 1, "second"), (3, 0, "end"), (3, 1, "")]
    assert [r.is_header for r in rows[:3]] == [True, True, False]


def test_nested_tables(spark):
    rows = html.cells(docs(spark, "<table><tr><td>a<table><tr><td>in</table>b<td>c</table>", name="html")).collect()
    assert sorted((r.table_no, r.c, r.value) for r in rows) == [(0, 0, "a b"), (0, 1, "c"), (1, 0, "in")]


def test_json_records(spark):
    text = '[{"id": 12345678901234567890, "x": 1.0, "e": 1e5, "n": null, "b": true, "s": "ü\\n"}, {"x": -0, "x": 2.50, "new": "y"}]'
    rows = records.json_records(docs(spark, text, "[]", "{}", '[{"a": [1, {"b": 2.0}]}]', "broken [")).orderBy("doc", "row_no").collect()
    assert rows[0].fields == {"id": "12345678901234567890", "x": "1.0", "e": "1e5", "n": "", "b": "true", "s": "ü\n", "new": ""}
    assert rows[1].fields["x"] == "2.50" and rows[1].header == ["id", "x", "e", "n", "b", "s", "new"]
    assert len(rows) == 3 and "JSONDecodeError" in rows[2].error
    assert records.json_records(docs(spark, '{"a": 1}\n\n{"b": 2}'), lines=True).count() == 2
    bad = records.bad_json_lines(docs(spark, '{"a": 1}\nnope\n\n{"b": 2}')).collect()
    assert [(r.doc, r.line_no) for r in bad] == [("0", 1)]


CARDS = """BEGIN:VCARD\r\nVERSION:3.0\r\nN:Doe;Jo;;;\r\nFN:Jo Doe\r\nORG:Acme;Sales\r\nitem1.TEL:+1 2\r\nitem1.X-ABLabel:_$!<Home>!$_\r\nEMAIL;TYPE=work:jo@\r\n example.com\r\nBDAY:19800102\r\nNOTE:a\\, b\\nc\r\nPHOTO;ENCODING=b:AAAA\r\nEND:VCARD\r\n
BEGIN:VCARD\nVERSION:2.1\nN:Müller;Eva\nTEL;WORK;VOICE:3\nNOTE;ENCODING=QUOTED-PRINTABLE;CHARSET=UTF-8:gr=C3=BC=\nn\nEND:VCARD"""


def test_contacts(spark):
    one, two = records.contacts(docs(spark, CARDS)).orderBy("row_no").collect()
    assert (one.name, one.organization, one.email, one.phone, one.birthday, one.note, one.photos) == ("Jo Doe", "Acme, Sales", "jo@example.com", "+1 2 (Home)", "1980-01-02", "a, b\nc", 1)
    assert (two.name, two.phone, two.note) == ("Müller Eva", "3", "grün")


def test_calendar(spark):
    text = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:Talk\\, long\nDTSTART:20240105T090000Z\nDTEND:20240105T103000Z\nLOCATION:Room\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:Trip\nDTSTART;VALUE=DATE:20240301\nDTEND;VALUE=DATE:20240304\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:Odd\nDTSTART:soon\nEND:VEVENT\nEND:VCALENDAR"
    rows = records.calendar(docs(spark, text)).orderBy(F.coalesce("start", F.to_timestamp(F.lit("1970-01-01")))).collect()
    assert [(r.summary, r.when) for r in rows] == [("Odd", "unrecognized date"), ("Talk, long", "Fri, 5 Jan 2024 09:00 – 10:30 UTC"), ("Trip", "Fri, 1 Mar 2024 – Sun, 3 Mar 2024")]


MAIL = "From: A <a@x.org>\nTo: b@x.org\nSubject: =?utf-8?q?gr=C3=BC=C3=9Fe?=\nDate: Mon, 01 Jan 2024 10:00:00 +0100\nContent-Type: text/html; charset=utf-8\n\n<p>hi</p>\n"


def test_mail(spark):
    one = records.messages(docs(spark, MAIL)).first()
    assert (one.from_, one.subject, one.body_type, one.body.strip(), one.date) == ("A <a@x.org>", "grüße", "text/html", "<p>hi</p>", "2024-01-01 10:00:00+0100")
    box = f"From a@x.org Mon\n{MAIL}\nFrom b@x.org Tue\nSubject: two\n\n>From here\n"
    parts = records.split_mailbox(docs(spark, box)).orderBy("pos").collect()
    assert len(parts) == 2 and parts[1].text.strip().endswith("\nFrom here")


def test_cues(spark):
    text = "﻿WEBVTT\n\nNOTE x\n\n1\n00:01.500 --> 00:02.000 align:left\n<v Ann>Hi <b>there</b>\nagain\n\n01:00:00,250 --> 01:00:01,000\nplain\n\nnot a cue"
    got = [(r.cue_no, r.start_s, r.end_s, r.speaker, r.text) for r in records.cues(docs(spark, text)).orderBy("cue_no").collect()]
    assert got == [(0, 1.5, 2.0, "Ann", "Hi there again"), (1, 3600.25, 3601.0, None, "plain")]


def test_notebook(spark):
    text = '{"nbformat": 4, "cells": [{"cell_type": "markdown", "source": ["# A\\n", "b"]}, {"cell_type": "code", "source": "1", "execution_count": 1, "outputs": [{"output_type": "stream", "text": ["x\\n"]}, {"output_type": "execute_result", "data": {"text/plain": ["p"], "text/html": "<b>"}}, {"output_type": "error", "traceback": ["\\u001b[31mE"]}]}]}'
    got = [(r.cell_type, r.source, r.output) for r in records.notebook_cells(docs(spark, text)).orderBy("pos").collect()]
    assert got == [("markdown", "# A\nb", ""), ("code", "1", "x\n\n<b>\nE")]


def test_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.executescript("CREATE TABLE b(x, y); INSERT INTO b VALUES (1, 2.0), (NULL, x'0011'); CREATE TABLE a(n INTEGER PRIMARY KEY AUTOINCREMENT); CREATE VIEW v AS SELECT x FROM b;")
    data = bytes(con.serialize())
    rows = records.sqlite_rows(docs(spark, data, name="content"), views=True).collect()
    assert [(r.name, r.fields) for r in rows] == [("b", {"x": "1", "y": "2.0"}), ("b", {"x": "", "y": "[blob 2 bytes]"}), ("v", {"x": "1"}), ("v", {"x": ""})]
    assert "DatabaseError" in records.sqlite_rows(docs(spark, b"SQLite format 3\0" + b"x" * 200, name="content")).first().error


@pytest.mark.parametrize(("raw", "text"), [("é".encode(), "é"), ("é".encode("cp1252") + b"\x93", "é“"), ("﻿é".encode(), "é"), ("abcd".encode("utf-16-le"), "abcd"), ("abcd".encode("utf-16-be"), "abcd"), ("﻿é".encode("utf-16-le"), "é"), (b"", "")])
def test_decoded(raw, text):
    assert files.decoded(raw) == text


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archive(spark):
    data = zipped(**{"a/x.txt": "1", "b/x.txt": "2", "../up.txt": "3", "__MACOSX/x": "4", ".hidden": "5", "c/X.TXT": "6"})
    rows = files.archive_entries(docs(spark, data, name="content")).orderBy("pos").collect()
    assert [(r.path, r.filename, bytes(r.content)) for r in rows] == [("a/x.txt", "x.txt", b"1"), ("b/x.txt", "x-2.txt", b"2"), ("c/X.TXT", "X-3.TXT", b"6")]


def test_archive_limits_give_an_error_and_no_part(spark):
    data = zipped(**{f"f{k}.txt": "x" * 10 for k in range(130)})
    assert files.archive_entries(docs(spark, data, name="content")).where("error is null").count() == 130
    for limit in ({"most_entries": 100}, {"most_bytes": 1000}):
        rows = files.archive_entries(docs(spark, data, name="content"), **limit).collect()
        assert len(rows) == 1 and "more than" in rows[0].error and rows[0].content is None
    assert [r.error is None for r in files.archive_entries(docs(spark, b"no archive", name="content")).collect()] == [False]


def test_json_lines_end_at_line_ends_only(spark):
    rows = records.json_records(docs(spark, '{"a": "x\u2028y\x85"}\r\n\n{"a": "z"}'), lines=True).orderBy("row_no").collect()
    assert [r.fields["a"] for r in rows] == ["x\u2028y\x85", "z"]
    deep = records.json_records(docs(spark, "[" * 10_000 + "]" * 10_000)).collect()
    assert len(deep) <= 1


def test_csv_cells(spark):
    text = '\ufeffa;b\n\n"x;1";"two\nlines"\n;\n'
    rows = records.csv_cells(docs(spark, text)).orderBy("r", "c").collect()
    assert [(r.r, r.c, r.value) for r in rows] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "x;1"), (1, 1, "two\nlines"), (2, 0, ""), (2, 1, "")]
    assert records.csv_cells(docs(spark, " \n ")).count() == 0


def test_workbook_escapes_what_xml_cannot_hold(spark):
    import re
    from xml.etree import ElementTree

    data = export.workbook([("S", [[("a\x01b", False), ("_x0041_", False)]])])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    found = [t.text for t in root.iter() if t.tag.endswith("}t")]
    assert [re.sub("_x([0-9A-F]{4})_", lambda m: chr(int(m[1], 16)), t) for t in found] == ["a\x01b", "_x0041_"]


def grid(spark, rows):
    return spark.createDataFrame([("d", 0, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "doc string, table_no int, r int, c int, value string")


def test_workbook_round_trip(spark):
    cells = grid(spark, [["Id", "Name", ""], ["7", 'a "q", b', "x"], ["007", "1.50", "<&>"]])
    back = files.workbook_cells(export.xlsx_parts(cells)).orderBy("r", "c").collect()
    assert [(r.r, r.c, r.value) for r in back] == [(r, c, v) for r, row in enumerate([["Id", "Name", ""], ["7", 'a "q", b', "x"], ["007", "1.50", "<&>"]]) for c, v in enumerate(row) if v]
    a, b = (export.xlsx_parts(cells).first().content for _ in range(2))
    assert a == b


def test_text_parts(spark):
    cells = grid(spark, [["Id", ""], ["7", "a|b"], ["08", 'say "x"']])
    assert export.csv_parts(cells).first().content == 'Id,\r\n7,a|b\r\n08,"say ""x"""\r\n'
    assert export.json_parts(cells).first().content == '[\n  {"Id": 7, "column2": "a|b"},\n  {"Id": "08", "column2": "say \\"x\\""}\n]\n'
    assert export.markdown_parts(cells).first().content == '| Id |  |\n| --- | --- |\n| 7 | a\\|b |\n| 08 | say "x" |\n'
    same = grid(spark, [["n", "n"], ["1", "2"]])
    assert export.json_parts(same).first().content == '[\n  ["n", "n"],\n  [1, 2]\n]\n'


def test_documents(spark):
    word = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    rows = files.document_blocks(docs(spark, zipped(**{"word/document.xml": word}), b"no zip", name="content")).orderBy("doc", "pos").collect()
    assert [(r.tag, r.text) for r in rows[:2]] == [("h1", "Top"), ("p", "a\tb")] and "BadZipFile" in rows[2].error
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>{}</a:t></a:p></p:sp></p:sld>'
    deck = zipped(**{f"ppt/slides/slide{k}.xml": slide.format(k) for k in (10, 2)})
    assert [(r.slide, r.tag, r.text) for r in files.slide_blocks(docs(spark, deck, name="content")).orderBy("slide").collect()] == [(0, "h2", "2"), (1, "h2", "10")]
    book = zipped(**{"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><itemref idref="b"/><itemref idref="a"/></p>', "o/b.xhtml": "<p>b</p>"})
    assert [(r.item, r.html, r.missing) for r in files.book_chapters(docs(spark, book, name="content")).orderBy("spine_pos").collect()] == [("b", "<p>b</p>", False), ("a", None, True)]


def test_grid_from_items(spark):
    want = [["Code", "Description", "Group"], ["A1", "first long text", "x"], ["B2", "second", "y"], ["C3", "third", "x"]]
    items = [("d", 1, v, 10.0 + 100 * c + 0.3 * (r % 2), 0.0, 12.0 * r + 0.4 * c, 10.0) for r, row in enumerate(want) for c, v in enumerate(row)]
    items.append(("d", 1, "continued", 110.0, 0.0, 12.0 * 4, 10.0))
    items += [("d", 2, "just a line of prose", 10.0, 0.0, 12.0 * k, 10.0) for k in range(9)]
    got = geometry.infer_cells(spark.createDataFrame(items, "doc string, page int, text string, x0 double, x1 double, y double, height double"))
    rows = {r.r: r.cells for r in C.rows_of(got).collect()}
    want[3][1] = "third continued"
    assert rows == dict(enumerate(want)) and {r.table_no for r in got.collect()} == {1}


def test_streams(spark, tmp_path):
    from quire import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"u": 1, "t": "2024-01-01T00:00:00Z"}\n{"u": 1, "t": "2024-01-01T00:30:00Z"}\n{"u": 1, "t": "2024-01-01T05:00:00Z"}\n')
    stream = streaming.pauses(streaming.json_lines(spark, str(tmp_path / "in"), "u long, t timestamp").where("bad is null"), "u", "t")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_csv_field_of_any_length(spark):
    rows = records.csv_cells(docs(spark, "a,b\n" + "x" * 300_000 + ",2")).orderBy("r", "c").collect()
    assert [len(r.value) for r in rows] == [1, 1, 300_000, 1]


def test_picture_sizes_with_decimals(spark):
    from quire.functions import text

    row = docs(spark, '<img src="a" width="12.5" height=".5px">').select(text.picture_pages(F.col("text")).alias("p")).first()
    assert [(p.width, p.height) for p in row.p] == [(12.5, 0.5)]


def test_unique_names(spark):
    from quire.operators import sequences

    given = ["a.txt", "a.txt", "a-2.txt", "a-2-2.txt", "A.TXT", "b", "b", "b-2", "b", "b-2", "b-2-3", ".x", ".x"]
    rows = sequences.unique_names(spark.createDataFrame([("k", n, v) for n, v in enumerate(given)], "k string, n int, name string"), ["k"], "n").orderBy("n").collect()
    made = [r.unique_name for r in rows]
    assert len({m.lower() for m in made}) == len(given)
    assert made == ["a.txt", "a-2-3.txt", "a-2.txt", "a-2-2.txt", "A-3.TXT", "b", "b-2-4", "b-2", "b-3", "b-2-2", "b-2-3", ".x", ".x-2"]
