"""Files as bytes: archives, text encodings, workbooks, documents, presentations and books in zip containers."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.detect import unsafe_archive_path
from quire.operators.sequences import unique_names
from quire.sources.common import parsed



def sources(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc, filename, content) of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def decoded(content: bytes, declared: str | None = None) -> str:
    """Bytes as text: by mark, else UTF-16 by its zero bytes, else UTF-8, else the declared encoding, else windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    head = content[:1024]
    even, odd = head[::2].count(0), head[1::2].count(0)
    if head and (even + odd) * 5 >= len(head) and max(even, odd) >= 8 * min(even, odd):
        return content.decode("utf-16-le" if odd > even else "utf-16-be", "replace")
    for name in ("utf-8", declared):
        try:
            if name:
                return content.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return content.decode("cp1252", "replace")


def texts(df: DataFrame, column: str = "content", doc: str = "doc") -> DataFrame:
    """(doc, text, error)."""
    return parsed(df, column, "text string", lambda b: [(decoded(bytes(b)),)], doc=doc)


def _entries(content: bytes, most_entries: int | None, most_bytes: int | None) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/") and not posixpath.basename(i.filename.replace("\\", "/")).startswith(".")]
        if most_entries is not None and len(infos) > most_entries:
            raise ValueError(f"the archive holds {len(infos)} files, more than {most_entries}")
        total = 0
        for n, info in enumerate(infos):
            with z.open(info) as f:
                data = f.read(-1 if most_bytes is None else most_bytes - total + 1)
            total += len(data)
            if most_bytes is not None and total > most_bytes:
                raise ValueError(f"the archive's files hold more than {most_bytes} bytes")
            yield n, info.filename, posixpath.basename(info.filename.replace("\\", "/")), data


def archive_entries(df: DataFrame, column: str = "content", doc: str = "doc", *, most_entries: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """(doc, pos, path, filename, content, error): an archive's files with safe paths, equal names made unique; archives in archives are not opened.

    No limit unless one is given; an archive beyond it, and a broken one, is one row with its error and without files.
    """
    rows = parsed(df, column, "pos int, path string, name string, content binary", lambda b: _entries(bytes(b), most_entries, most_bytes), doc=doc)
    good = unique_names(rows.where("error is null").where(~unsafe_archive_path(F.col("path"))), ["doc"], "pos").select("doc", "pos", "path", F.col("unique_name").alias("filename"), "content", "error")
    return good.unionByName(rows.where("error is not null").select("doc", "pos", "path", F.col("name").alias("filename"), "content", "error"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _workbook(content: bytes) -> Iterator[tuple]:
    """Filled rows of an xlsx workbook as the numbers of their columns and their cells: shared and inline strings and numbers as they are stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "content.xml" in names:
            yield from _open_sheets(z)
            return
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
        for k, sheet in enumerate(sheets):
            target = relations[next(v for a, v in sheet.attrib.items() if _local(a) == "id" and a != "sheetId")]
            with z.open(posixpath.normpath(posixpath.join("xl", target.lstrip("/").removeprefix("xl/")))) as f:
                data, at, columns, values = None, -1, [], []
                for event, e in ElementTree.iterparse(f, ("start", "end")):
                    tag = _local(e.tag)
                    if event == "start":
                        data = e if tag == "sheetData" else data
                    elif tag == "c":
                        kind, ref = e.get("t"), re.match(r"([A-Z]+)(\d+)", e.get("r") or "A1")
                        value = "".join(t.text or "" for t in e.iter() if _local(t.tag) in ("v", "t"))
                        if value:
                            r, column = int(ref[2]) - 1, 0
                            for letter in ref[1]:
                                column = column * 26 + ord(letter) - 64
                            if r != at and columns:
                                yield k, sheet.get("name"), at, columns, values
                                columns, values = [], []
                            at = r
                            columns.append(column - 1)
                            values.append(shared[int(value)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}[value] if kind == "b" else value)
                        e.clear()
                    elif tag == "row" and data is not None:
                        data.clear()  # a row that is read is kept no longer
                if columns:
                    yield k, sheet.get("name"), at, columns, values


def _open_sheets(z: zipfile.ZipFile) -> Iterator[tuple]:
    root = ElementTree.fromstring(z.read("content.xml"))
    for k, sheet in enumerate(x for x in root.iter() if _local(x.tag) == "table"):
        attribute = lambda e, name: next((v for a, v in e.attrib.items() if _local(a) == name), None)
        r = 0
        for row in (x for x in sheet.iter() if _local(x.tag) == "table-row"):
            times, c = int(attribute(row, "number-rows-repeated") or 1), 0
            columns, values = [], []
            for cell in row:
                n = int(attribute(cell, "number-columns-repeated") or 1)
                text = "\n".join("".join(p.itertext()) for p in cell if _local(p.tag) == "p")
                if text:
                    columns += range(c, c + n)
                    values += [text] * n
                c += n
            for i in range(times if columns else 0):
                yield k, attribute(sheet, "name"), r + i, columns, values
            r += times


def workbook_cells(df: DataFrame, column: str = "content", doc: str = "doc") -> DataFrame:
    """(doc, table_no, sheet, r, c, value, error): the filled cells of xlsx and ods workbooks."""
    each = lambda b: ((k, name, r, c, value) for k, name, r, columns, values in _workbook(b) for c, value in zip(columns, values, strict=True))
    return parsed(df, column, "table_no int, sheet string, r int, c int, value string", each, doc=doc)


def workbook_rows(df: DataFrame, column: str = "content", doc: str = "doc") -> DataFrame:
    """(doc, table_no, sheet, r, columns, values, error): workbook_cells() with the filled cells of a row as two arrays."""
    return parsed(df, column, "table_no int, sheet string, r int, columns array<int>, values array<string>", _workbook, doc=doc)


def _document(content: bytes) -> Iterator[tuple]:
    """Paragraphs and headings of docx and odt files in order; a table's cell is a paragraph with its place as tag."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        word = "word/document.xml" in z.namelist()
        root = ElementTree.fromstring(z.read("word/document.xml" if word else "content.xml"))
        n = 0
        for p in root.iter():
            kind = _local(p.tag)
            if kind not in ("p", "h"):
                continue
            style = next((v for s in p.iter() if _local(s.tag) == "pStyle" for a, v in s.attrib.items() if _local(a) == "val"), "")
            level = re.match(r"(?i)heading\s*([1-6])$", style)
            if kind == "h":
                level = re.match(r"([1-6])", next((v for a, v in p.attrib.items() if _local(a) == "outline-level"), "1"))
            parts = []
            for t in p.iter():
                name = _local(t.tag)
                if name == "tab":
                    parts.append("\t")
                elif name in ("br", "line-break"):
                    parts.append("\n")
                elif word and name == "t":
                    parts.append(t.text or "")
            text = "".join(parts) if word else "".join(p.itertext())
            if text.strip():
                yield n, f"h{level[1]}" if level else "p", int(level[1]) if level else 0, text
                n += 1


def document_blocks(df: DataFrame, column: str = "content", doc: str = "doc") -> DataFrame:
    """(doc, pos, tag, level, text, error)."""
    return parsed(df, column, "pos int, tag string, level int, text string", _document, doc=doc)


def _slides(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        numbered = sorted((int(m[1]), name) for name in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name)))
        for k, (_, name) in enumerate(numbered):
            n = 0
            for shape in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "sp"):
                title = any(_local(x.tag) == "ph" and x.get("type") in ("title", "ctrTitle") for x in shape.iter())
                for p in (x for x in shape.iter() if _local(x.tag) == "p"):
                    text = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t")
                    if text.strip():
                        yield k, n, "h2" if title else "p", text
                        n += 1


def slide_blocks(df: DataFrame, column: str = "content", doc: str = "doc") -> DataFrame:
    """(doc, slide, pos, tag, text, error) of pptx files, slides by number."""
    return parsed(df, column, "slide int, pos int, tag string, text string", _slides, doc=doc)


def _chapters(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        root = ElementTree.fromstring(z.read(package))
        items = {x.get("id"): x.get("href") for x in root.iter() if _local(x.tag) == "item"}
        order = [x.get("idref") for x in root.iter() if _local(x.tag) == "itemref"] or list(items)
        names = set(z.namelist())
        for k, item in enumerate(order):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(package), items.get(item) or ""))
            yield k, item, items.get(item), z.read(path).decode("utf-8", "replace") if path in names else None


def book_chapters(df: DataFrame, column: str = "content", doc: str = "doc") -> DataFrame:
    """(doc, spine_pos, item, href, html, missing, error) of epub files in reading order."""
    return parsed(df, column, "spine_pos int, item string, href string, html string", _chapters, doc=doc).withColumn("missing", F.col("html").isNull() & F.col("error").isNull())


def numbered(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
