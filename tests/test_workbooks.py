"""Workbooks of part files: bytes, sheets, escapes, and what failed attempts leave."""

import glob
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import files, records, workbooks
from quire.sources.common import _pieces


def test_equal_bytes_and_split_sheets(spark, tmp_path):
    df = spark.range(0, 25, numPartitions=2).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("none"))
    for name in ("one", "two"):
        workbooks.write_workbooks(df, str(tmp_path / name), most_rows=6)
    ones, twos = (sorted(glob.glob(f"{tmp_path}/{name}/*.xlsx")) for name in ("one", "two"))
    assert len(ones) == 2 and [open(a, "rb").read() for a in ones] == [open(b, "rb").read() for b in twos]
    with zipfile.ZipFile(ones[0]) as z:
        assert sum("worksheets/sheet" in n for n in z.namelist()) == 3 and z.testzip() is None
    cells = files.workbook_cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(str(tmp_path / "one")).select(F.col("path").alias("doc"), "content")).collect()
    assert {r.value for r in cells if r.r == 0} == {"id", "text", "none"}
    assert sorted(int(r.value) for r in cells if r.r > 0 and r.c == 0) == list(range(25))
    assert {r.sheet for r in cells} == {"Rows", "Rows (2)", "Rows (3)"}


def test_failed_tasks_leave_no_workbook(spark, tmp_path):
    broken = spark.range(0, 4, numPartitions=2).select(F.when(F.col("id") < 3, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("stop"))).alias("x"))
    with pytest.raises(Exception, match="stop"):
        workbooks.write_workbooks(broken, str(tmp_path / "out"))
    assert glob.glob(f"{tmp_path}/out/*.xlsx") == [] and glob.glob(f"{tmp_path}/out/_SUCCESS") == []


def test_empty_table(spark, tmp_path):
    workbooks.write_workbooks(spark.createDataFrame([], "a int, b string").coalesce(1), str(tmp_path / "none"))
    for path in glob.glob(f"{tmp_path}/none/*.xlsx"):
        with zipfile.ZipFile(path) as z:
            assert b"<t xml:space=\"preserve\">b</t>" in z.read("xl/worksheets/sheet1.xml")


def test_letters():
    assert [workbooks.letters(n) for n in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    """A reader holds a whole file, so the size of a partition must not be that of a file."""
    df = spark.range(0, 250_000, numPartitions=1)
    workbooks.write_csv(df, str(tmp_path / "csv"))
    assert len(glob.glob(f"{tmp_path}/csv/*.csv")) == 3
    workbooks.write_workbooks(spark.range(0, 25, numPartitions=2), str(tmp_path / "xlsx"), most_rows=4, file_rows=10)
    assert len(glob.glob(f"{tmp_path}/xlsx/*.xlsx")) == 4
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(str(tmp_path / "xlsx")).select(F.col("path").alias("doc"), "content")
    rows = files.workbook_rows(found).where("r > 0").collect()
    assert sorted(int(v) for r in rows for v in r["values"]) == list(range(25)) and all(r["columns"] == [0] for r in rows)


def test_rows_of_a_long_document_come_in_pieces():
    """All or none, without a list of all."""
    def broken():
        yield from range(10)
        raise ValueError

    assert [list(p) for p in _pieces(range(10), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert [list(p) for p in _pieces(range(3), 4)] == [[0, 1, 2]] and [list(p) for p in _pieces([], 4)] == [[]]
    with pytest.raises(ValueError):
        next(_pieces(broken(), 4))


def test_csv_rows_are_not_listed():
    """Reading one row of a text takes one row of its parser."""
    rows = records._csv("a,b\n" * 100_000)
    assert not isinstance(rows, list) and next(rows) == (0, ["a", "b"])
