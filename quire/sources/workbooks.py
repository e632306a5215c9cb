"""Records written as workbooks by the tasks that hold them: a data source of part files, each a whole workbook.

A task streams its rows through the compressor into files of FILE_ROWS rows, so memory holds a batch of rows and nothing else; a sheet
that is full goes on in the next with the header repeated. Files are written under a name of their attempt, and the commit, which
gets only names, gives them their final ones: a lost task leaves no half file behind, and a second attempt no second copy.
The folder must be one that driver and executors share. Equal rows in equal partitions give equal bytes.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import NumericType, StructType

from quire.functions.numbers import is_typed, json_string, json_value

#: The rows of a sheet, the name spaces and parts of a workbook.
MOST_ROWS = 1_048_576
#: The rows of a file: whoever reads files as documents holds one, so more rows make more files.
FILE_ROWS = 100_000
STAMP = (1980, 1, 1, 0, 0, 0)
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
CONTENT = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def letters(n: int) -> str:
    """A column's letters from its number, from 0."""
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def cell_text(text: str) -> str:
    """Text in a sheet: what XML cannot hold, and what reads as such an escape, by its number as _xHHHH_."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


class Workbook:
    """A workbook written to a file sheet by sheet, row by row."""

    def __init__(self, path: str, header: list[str], most_rows: int = MOST_ROWS):
        self.file = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True)
        self.header, self.most_rows, self.sheets, self.row, self.part = header, most_rows, 0, 0, None
        self.names = [letters(c) for c in range(len(header))]

    def _start(self) -> None:
        self._end()
        self.sheets, self.row = self.sheets + 1, 0
        self.part = self.file.open(self._entry(f"xl/worksheets/sheet{self.sheets}.xml"), "w", force_zip64=True)
        self.part.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
        self._put(self.header, "t" * len(self.header))

    def _end(self) -> None:
        if self.part is not None:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    @staticmethod
    def _entry(name: str) -> zipfile.ZipInfo:
        entry = zipfile.ZipInfo(name, STAMP)
        entry.compress_type = zipfile.ZIP_DEFLATED
        return entry

    def _put(self, values: list[str | None], kinds: str) -> None:
        self.row += 1
        cells = []
        for name, value, kind in zip(self.names, values, kinds, strict=True):
            if value:
                cells.append(f'<c r="{name}{self.row}"><v>{value}</v></c>' if kind == "n" else f'<c r="{name}{self.row}" t="inlineStr"><is><t xml:space="preserve">{cell_text(value)}</t></is></c>')
        self.part.write(f'<row r="{self.row}">{"".join(cells)}</row>'.encode())

    def add(self, values: list[str | None], kinds: str) -> None:
        if self.part is None or self.row >= self.most_rows:
            self._start()
        self._put(values, kinds)

    def close(self) -> None:
        if not self.sheets:
            self._start()
        self._end()
        numbers = range(1, self.sheets + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{CONTENT}.worksheet+xml"/>' for k in numbers)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{CONTENT}.sheet.main+xml"/>{kinds}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATION}"><sheets>' + "".join(f'<sheet name="Rows{"" if k == 1 else f" ({k})"}" sheetId="{k}" r:id="rId{k}"/>' for k in numbers) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{RELATION}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>",
        }
        for name, text in parts.items():
            self.file.writestr(self._entry(name), HEAD + text)
        self.file.close()


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written: the name of each under its attempt, and its final one."""

    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceArrowWriter):
    """Writes rows (values array<string>, kinds string): kinds has a letter for each cell, n for a number and t for text."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.header = options["header"].split("\x1f")
        self.most_rows = int(options.get("most_rows", MOST_ROWS))
        self.file_rows = int(options.get("file_rows", FILE_ROWS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}"
        files: list[tuple[str, str]] = []

        def begun() -> Workbook:
            files.append((os.path.join(self.path, f".{uuid.uuid4().hex}.tmp"), os.path.join(self.path, f"{name}-{len(files):05d}.xlsx" if files else f"{name}.xlsx")))
            return Workbook(files[-1][0], self.header, self.most_rows)

        book, held = begun(), 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                for values, kinds in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if held == self.file_rows:
                        book.close()
                        book, held = begun(), 0
                    book.add(values, kinds)
                    held += 1
        book.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for temporary, final in m.files:
                os.replace(temporary, final)
        with open(os.path.join(self.path, "_SUCCESS"), "w"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for temporary, _ in m.files:
                if os.path.exists(temporary):
                    os.remove(temporary)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_xlsx"

    def schema(self) -> str:
        return "values array<string>, kinds string"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options)


def _text_of(df: DataFrame) -> list[tuple[str, Column, Column]]:
    """For each column its name, its text, and whether that is a number as a cell: numbers that are finite, and texts that a number prints back."""
    out = []
    for f in df.schema.fields:
        text = F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(""))
        finite = text.rlike(r"^-?[0-9]") if isinstance(f.dataType, NumericType) else is_typed(text)
        out.append((f.name, text, finite))
    return out


def write_workbooks(df: DataFrame, path: str, most_rows: int = MOST_ROWS, file_rows: int = FILE_ROWS) -> None:
    """A folder of workbooks, one for each file_rows rows of a partition of df, in their order under a header. Sheets hold most_rows rows with the header."""
    df.sparkSession.dataSource.register(Workbooks)
    columns = _text_of(df)
    rows = df.select(F.array(*[t for _, t, _ in columns]).alias("values"), F.concat(*[F.when(n, "n").otherwise("t") for _, _, n in columns]).alias("kinds"))
    rows.write.format("quire_xlsx").option("header", "\x1f".join(n for n, _, _ in columns)).option("most_rows", most_rows).option("file_rows", file_rows).mode("append").save(path)


def write_csv(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """A folder of csv files of file_rows rows at most, under a header each, quoted only where a cell needs it; null and empty cells are empty."""
    keep = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*[t.alias(n) for n, t, _ in _text_of(df)]).write.options(header=True, maxRecordsPerFile=file_rows, **keep).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A folder of JSON Lines: an object a row with every column, numbers as they are written, empty and null cells as empty strings."""
    columns = _text_of(df)
    pairs = [F.concat(json_string(F.lit(n)), F.lit(":"), F.when(number, text).otherwise(json_value(text))) for n, text, number in columns]
    df.select(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("value")).write.text(path)
