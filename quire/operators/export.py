"""Tables and documents as files: text parts for Spark's writers, and workbooks and books as bytes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.cells import csv_lines, json_rows, pipe_rows, rows_of

STAMP = (1980, 1, 1, 0, 0, 0)
NUMBER = r"^-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,12})?$"


def _parts(lines: DataFrame, order: str, text: str, by: str, suffix: str, head: str = "", tail: str = "") -> DataFrame:
    whole = lines.groupBy("doc", "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), by).alias("body"))
    name = F.when(F.col("table_no") == 0, suffix).otherwise(F.concat(F.lit("-"), (F.col("table_no") + 1).cast("string"), F.lit(suffix)))
    return whole.select("doc", "table_no", name.alias("suffix"), F.concat(F.lit(head), "body", F.lit(tail)).alias("content"))


def csv_parts(cells: DataFrame) -> DataFrame:
    """(doc, table_no, suffix, content): a csv text of each table that is not blank."""
    return _parts(csv_lines(cells), "r", "line", "\r\n", ".csv", tail="\r\n")


def json_parts(cells: DataFrame) -> DataFrame:
    return _parts(json_rows(cells), "r", "row", ",\n  ", ".json", "[\n  ", "\n]\n")


def markdown_parts(cells: DataFrame) -> DataFrame:
    return _parts(pipe_rows(cells), "line_no", "line", "\n", ".md", tail="\n")


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _cell_text(text: str) -> str:
    """A cell's text in a workbook's XML: what XML cannot hold, and what reads as such an escape, by its number as _xHHHH_."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text))


def workbook(sheets: list[tuple[str, list[list[tuple[str, bool]]]]]) -> bytes:
    """An xlsx file with the same bytes every time; cells are (text, whether it is a number), empty ones are left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(path: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(path, STAMP), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text, zipfile.ZIP_DEFLATED)

        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        put("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        put("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{relation}"><sheets>' + "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{relation}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (_, rows) in enumerate(sheets, 1):
            body = []
            for r, row in enumerate(rows, 1):
                body.append(f'<row r="{r}">')
                body += [f'<c r="{_letters(c)}{r}"><v>{t}</v></c>' if number else f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{_cell_text(t)}</t></is></c>' for c, (t, number) in enumerate(row) if t]
                body.append("</row>")
            put(f"xl/worksheets/sheet{k}.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(body) + "</sheetData></worksheet>")
    return out.getvalue()


def xlsx_parts(cells: DataFrame) -> DataFrame:
    """(doc, content): one workbook a document, a sheet a table; a group is one document's tables."""

    def write(part: pd.DataFrame) -> pd.DataFrame:
        sheets = []
        for n, table in part.sort_values(["table_no", "r"]).groupby("table_no"):
            sheets.append((f"Table {n + 1}", [[(v, bool(t)) for v, t in zip(row.cells, row.typed, strict=True)] for row in table.itertuples()]))
        return pd.DataFrame({"doc": [part["doc"].iloc[0]], "content": [workbook(sheets)]})

    from quire.functions.numbers import is_typed

    rows = rows_of(cells)
    typed = rows.withColumn("typed", F.transform("cells", lambda v: is_typed(v) & v.rlike(NUMBER)))
    return typed.groupBy("doc").applyInPandas(write, "doc string, content binary")
