"""Record files: JSON arrays and lines, contacts, calendars, databases, mail, captions and notebooks."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import quopri
import re
import sqlite3
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from itertools import islice, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import jsontext
from quire.sources.common import parsed

csv.field_size_limit(2**31 - 1)  # the library's own limit is 131,072 characters a field

FIELDS = "row_no long, fields map<string,string>, header array<string>"
CONTACT = ("name", "organization", "title", "email", "phone", "address", "birthday", "url", "note")


def json_records(df: DataFrame, column: str = "text", doc: str = "doc", *, lines: bool = False) -> DataFrame:
    """(doc, row_no, fields, header, error); numbers stay as they are written, missing fields are empty, of repeated keys the last counts. A bad line is an error of its own."""
    return jsontext.records(df, column, doc, lines=lines)


def _fields(text: str, delimiter: str, most: int | None = None) -> Iterator[list[str]]:
    return islice(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), most)


def _csv(text: str) -> Iterator[tuple[int, list[str]]]:
    """Rows of delimited text, numbered: the delimiter is the one whose first ten rows differ least in their number of fields, then that with the most."""
    text = text.lstrip("\ufeff").strip()
    filled = lambda r: len(r) > 1 or (r and r[0].strip())

    def score(mark: str) -> tuple[int, int]:
        counts = [len(r) for r in _fields(text, mark, 10) if filled(r)]
        return sum(a != b for a, b in pairwise(counts)), -sum(counts)

    split = [m for m in ",;\t" if m in text] or [","]
    best = split[0] if len(split) == 1 else min(split, key=score)
    return enumerate(filter(filled, _fields(text, best)))


def csv_rows(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, table_no, r, cells, error): csv_cells() with the cells of a row as an array."""
    return parsed(df, column, "r int, cells array<string>", _csv, doc=doc).select("doc", F.lit(0).alias("table_no"), "r", "cells", "error")


def csv_cells(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, table_no, r, c, value, error) of csv, semicolon or tab separated texts, without blank rows; see cells.trim_trailing and cells.has_header for what follows."""
    return parsed(df, column, "r int, c int, value string", lambda t: ((r, c, value) for r, row in _csv(t) for c, value in enumerate(row)), doc=doc).select("doc", F.lit(0).alias("table_no"), "r", "c", "value", "error")


def bad_json_lines(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, line_no) of filled lines that are not JSON; no Python."""
    lines = df.select(F.col(doc).alias("doc"), F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")
    return lines.where(F.try_parse_json("line").isNull()).select("doc", "line_no")


def _unfolded(text: str) -> list[str]:
    return re.sub(r"\r?\n[ \t]", "", text.lstrip("﻿").replace("\r\n", "\n")).split("\n")


def _property(line: str) -> tuple[str, str, dict[str, list[str]], str] | None:
    m = re.match(r"^(?:([\w-]+)\.)?([\w-]+)((?:;(?:[^\":;]|\"[^\"]*\")*)*):(.*)$", line, re.S)
    if not m:
        return None
    params: dict[str, list[str]] = {}
    for p in filter(None, m[3].split(";")):
        name, _, value = p.partition("=")
        params.setdefault(name.upper() if value else "TYPE", []).extend(x.strip('"') for x in (value or name).split(","))
    value = m[4]
    if "QUOTED-PRINTABLE" in [x.upper() for v in params.values() for x in v]:
        value = quopri.decodestring(value.encode("latin-1", "replace")).decode(params.get("CHARSET", ["utf-8"])[0], "replace")
    return (m[1] or "").lower(), m[2].upper(), params, value


def _plain(value: str, by: str = " ") -> str:
    parts = [re.sub(r"\\([\;,])", r"\1", re.sub(r"\\[nN]", "\n", p)).strip() for p in re.split(r"(?<!\\);", value)]
    return by.join(p for p in parts if p)


def _contacts(text: str) -> Iterator[tuple]:
    text = re.sub(r"=\r?\n", "", text) if "QUOTED-PRINTABLE" in text.upper() else text
    card, depth, n = None, 0, 0
    for line in _unfolded(text):
        p = _property(line)
        if p is None:
            continue
        group, name, _, value = p
        if name == "BEGIN" and value.strip().upper() == "VCARD":
            depth += 1
            card = {} if depth == 1 else card
        elif name == "END" and value.strip().upper() == "VCARD":
            depth = max(0, depth - 1)
            if depth == 0 and card is not None:
                labels = {k[1]: v[0] for k, v in card.items() if k[0] == "X-ABLABEL"}
                named = _plain(card.get(("N", ""), [""])[0])
                of = lambda key: "; ".join(f"{v} ({_plain(labels[k[1]]).strip('_$!<>')})" if k[1] in labels else v for k, vs in card.items() if k[0] == key for v in vs)
                photos = sum(len(vs) for k, vs in card.items() if k[0] in ("PHOTO", "LOGO"))
                yield (n, of("FN") or named, of("ORG"), of("TITLE"), of("EMAIL"), of("TEL"), of("ADR"), re.sub(r"^(\d{4})-?(\d\d)-?(\d\d).*", r"\1-\2-\3", of("BDAY")), of("URL"), of("NOTE"), photos)
                n, card = n + 1, None
        elif depth == 1:
            card.setdefault((name, group), []).append(value if name in ("N", "X-ABLABEL") else _plain(value, ", " if name in ("ADR", "ORG") else "; "))


def contacts(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, row_no, the nine text columns of CONTACT, photos, error) of vCards 2.1 to 4.0; cards inside cards are passed over."""
    return parsed(df, column, "row_no int, " + ", ".join(f"{c} string" for c in CONTACT) + ", photos int", _contacts, doc=doc)


def _events(text: str) -> Iterator[tuple]:
    inside, event, n = False, {}, 0
    for line in _unfolded(text):
        p = _property(line)
        if p is None:
            continue
        _, name, params, value = p
        if name == "BEGIN" and value == "VEVENT":
            inside, event = True, {}
        elif name == "END" and value == "VEVENT":
            inside = False
            whole = len(event.get("DTSTART", "")) == 8
            yield n, event.get("SUMMARY", ""), event.get("LOCATION", ""), event.get("ORGANIZER", "").removeprefix("mailto:"), event.get("DTSTART"), event.get("DTEND"), whole, event.get("DESCRIPTION", "")
            n += 1
        elif inside:
            event.setdefault(name, value if name in ("DTSTART", "DTEND") else re.sub(r"\\([\;,])", r"\1", re.sub(r"\\[nN]", "\n", value)))


def calendar(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, pos, summary, location, organizer, start, end, all_day, when, description, error), to be ordered by start, those without one first.

    Times are in UTC; an all-day event ends on the day before its (exclusive) end.
    """
    rows = parsed(df, column, "pos int, summary string, location string, organizer string, raw_start string, raw_end string, all_day boolean, description string", _events, doc=doc)
    at = lambda c: F.coalesce(F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    timed = rows.withColumns({"start": at("raw_start"), "end": at("raw_end")})
    day = lambda c: F.date_format(c, "EEE, d MMM yyyy")
    last = F.date_sub("end", 1)
    whole = F.when(F.col("end").isNull() | (last <= F.to_date("start")), day("start")).otherwise(F.concat(day("start"), F.lit(" – "), day(last)))
    clock = F.when(F.to_date("start") == F.to_date("end"), F.date_format("end", "HH:mm")).otherwise(F.concat(day("end"), F.date_format("end", " HH:mm")))
    hours = F.concat(day("start"), F.date_format("start", " HH:mm"), F.coalesce(F.concat(F.lit(" – "), clock), F.lit("")), F.lit(" UTC"))
    return timed.withColumn("when", F.when(F.col("start").isNull(), "unrecognized date").when(F.col("all_day"), whole).otherwise(hours)).drop("raw_start", "raw_end")


def _message(raw: str) -> Iterator[tuple]:
    m = email.message_from_string(raw, policy=email.policy.default)
    body = m.get_body(preferencelist=("html", "plain"))
    text = body.get_content() if body is not None else ""
    try:
        date = parsedate_to_datetime(m["date"]).strftime("%Y-%m-%d %H:%M:%S%z") if m["date"] else None
    except ValueError:
        date = None
    files = [f"{p.get_filename() or 'unnamed'} ({len(p.get_payload(decode=True) or b'')})" for p in m.iter_attachments() if not p["content-id"]]
    yield str(m["from"] or ""), str(m["to"] or ""), str(m["cc"] or ""), str(m["subject"] or ""), date, body.get_content_type() if body is not None else None, text, files


def messages(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, from_, to_, cc, subject, date, body_type, body, attachments, error); an HTML body before a plain one, attachments with a Content-ID left out."""
    return parsed(df, column, "from_ string, to_ string, cc string, subject string, date string, body_type string, body string, attachments array<string>", _message, doc=doc)


def split_mailbox(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, pos, text): the messages of a mailbox, one quote mark taken from quoted From lines; no Python."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(column, "\r\n", "\n")), r"\nFrom \S+[^\n]*\n"), lambda p: F.trim(p) != "")
    each = df.select(F.col(doc).alias("doc"), F.posexplode(parts).alias("pos", "text"))
    return each.withColumn("text", F.regexp_replace("text", r"(?m)^>(>*From )", "$1"))


def cues(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, cue_no, start_s, end_s, speaker, text) of WebVTT and SRT captions; no Python."""
    text = F.regexp_replace(F.regexp_replace(column, "﻿", ""), r"\r\n?", "\n")
    each = df.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("n", "block")).withColumn("block", F.trim("block", F.lit("\n \t")))
    stamp = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"
    timing = rf"^(?:(?!.*-->)[^\n]*\n)?[ \t]*{stamp}\s+-->\s+{stamp}[^\n]*(?:\n|$)"
    seconds = lambda g: F.aggregate(F.split(F.replace(F.regexp_extract("block", timing, g), F.lit(","), F.lit(".")), ":"), F.lit(0.0), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    found = each.where(F.col("block").rlike(timing) & ~F.col("block").rlike(r"^(WEBVTT|NOTE|STYLE|REGION)(\s|$)"))
    said = F.regexp_replace("block", timing, "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(said, r"<[^>]*>", ""), r"\s+", " "))
    rows = found.select("doc", "n", seconds(1).alias("start_s"), seconds(2).alias("end_s"), F.nullif(F.trim(F.regexp_extract(said, r"<v(?:\.[^\s>]*)?\s+([^>]+)>", 1)), F.lit("")).alias("speaker"), bare.alias("text")).where("text <> ''")
    from pyspark.sql import Window

    return rows.withColumn("cue_no", F.row_number().over(Window.partitionBy("doc").orderBy("n")) - 1).drop("n")


NOTEBOOK = "struct<nbformat:int,cells:array<struct<cell_type:string,source:variant,execution_count:int,outputs:array<struct<output_type:string,text:variant,data:map<string,variant>,traceback:array<string>>>>>>"


def notebook_cells(df: DataFrame, column: str = "text", doc: str = "doc") -> DataFrame:
    """(doc, pos, cell_type, source, output) of notebooks: an output's picture by type, else HTML, else text, without escape codes; no Python."""

    def joined(v: Column) -> Column:
        return F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"))

    each = df.select(F.col(doc).alias("doc"), F.posexplode(F.from_json(column, NOTEBOOK)["cells"]).alias("pos", "cell"))
    bundle = lambda o: F.coalesce(*(joined(F.try_element_at(o["data"], F.lit(t))) for t in ("image/png", "image/jpeg", "image/svg+xml", "text/html", "text/plain")), joined(o["text"]), F.array_join(o["traceback"], "\n"))
    outputs = F.array_join(F.transform(F.coalesce("cell.outputs", F.expr("cast(array() as array<struct<output_type:string,text:variant,data:map<string,variant>,traceback:array<string>>>)")), bundle), "\n")
    return each.select("doc", "pos", "cell.cell_type", joined(F.col("cell.source")).alias("source"), F.regexp_replace(outputs, r"\x1b?\[[0-9;]*m", "").alias("output"))


def _tables(content: bytes, views: bool) -> Iterator[tuple]:
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(bytes(content))
        kinds = ("table", "view") if views else ("table",)
        objects = [r for r in con.execute("SELECT type, name FROM sqlite_schema WHERE name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY type, name") if r[0] in kinds]
        for kind, name in objects:
            quoted = '"' + name.replace('"', '""') + '"'
            got = con.execute(f"SELECT * FROM {quoted}")
            header = [d[0] for d in got.description]
            for k, row in enumerate(got):
                yield name, kind, k, {h: _sqlite_cell(v) for h, v in zip(header, row, strict=True)}, header
    finally:
        con.close()


def _sqlite_cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bytes):
        return f"[blob {len(v)} bytes]" if len(v) < 1024 else f"[blob {len(v) / 1024:.1f} KB]"
    if isinstance(v, float):
        s = f"{v:.15g}"
        return s if re.search(r"[.n]", s) else s.replace("e", ".0e") if "e" in s else f"{s}.0"
    return str(v)


def sqlite_rows(df: DataFrame, column: str = "content", doc: str = "doc", *, views: bool = False) -> DataFrame:
    """(doc, name, kind, row_no, fields, header, error) of database files, tables by name and then, if asked for, views."""
    return parsed(df, column, "name string, kind string, " + FIELDS, lambda b: _tables(b, views), doc=doc)
