"""Detection and scalar functions over documents, pages, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import detect, numbers, text
from quire.operators import jsontext, lines, sequences
from quire.plans.common import read

NAMES = ("report.txt", "notes.md", "data.csv", "people.vcf", "page.HTML", "archive.tar.gz", "figure.tiff", "noextension", "deck.pptm", "log.2024.jsonl")


def _mail(orders: DataFrame) -> DataFrame:
    """A short mail of each order; some lack headers, some are the start of a mailbox, some are lists."""
    k = F.col("o_orderkey")
    head = F.concat(F.lit("From: c"), "o_custkey", F.lit("@example.com\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n"))
    subject = F.when(k % 3 == 0, F.concat(F.lit("Subject: order "), k, F.lit("\n"))).when(k % 3 == 1, F.lit("To: shop@example.com\n")).otherwise("")
    first = F.when(k % 5 == 0, F.concat(F.lit("From c"), "o_custkey", F.lit(" 2024\n"))).otherwise("")
    body = F.when(k % 7 == 0, F.concat(F.lit("- "), "o_orderpriority")).when(k % 7 == 1, F.concat(F.lit("a,b\n1,"), "o_orderstatus")).otherwise(F.col("o_orderpriority"))
    mail = F.concat(first, head, subject, F.lit("\n"), body)
    return orders.select(k, F.when(k % 11 < 8, mail).otherwise(body).alias("text"), F.element_at(F.array(*(F.lit(n) for n in NAMES)), (k % 10 + 1).cast("int")).alias("name"))


_MAIL = """mail AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 < 8 THEN
   CASE WHEN o_orderkey % 5 = 0 THEN 'From c' || o_custkey || ' 2024' || chr(10) ELSE '' END || 'From: c' || o_custkey || '@example.com' || chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10)
   || CASE o_orderkey % 3 WHEN 0 THEN 'Subject: order ' || o_orderkey || chr(10) WHEN 1 THEN 'To: shop@example.com' || chr(10) ELSE '' END || chr(10) || body ELSE body END AS text,
  (['""" + "', '".join(NAMES) + """'])[o_orderkey % 10 + 1] AS name
  FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN '- ' || o_orderpriority WHEN 1 THEN 'a,b' || chr(10) || '1,' || o_orderstatus ELSE o_orderpriority END AS body FROM orders))"""
_BY_NAME = {e: f for f, exts in detect.EXTENSIONS.items() for e in exts.split()}
_EXT = "lower(regexp_extract(name, '\\.([^.\\\\/]+)$', 1))"
_FORMAT = f"CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in _BY_NAME.items()) + " END"
_MD = " OR ".join(f"regexp_matches(text, '{p}')" for p in detect.MARKDOWN)
_CSV = "len(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda l: trim(l) <> '')) >= 2 AND (" + " OR ".join(f"(len(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda l: trim(l) <> ''), lambda l: len(string_split(l, {d}))))) = 1 AND len(string_split(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda l: trim(l) <> '')[1], {d})) >= 2)" for d in ("','", "';'", "chr(9)")) + ")"
_HEADERS = "list_filter(regexp_split_to_array(regexp_extract(text, '(?s)^(.*?)(?:\\r?\\n[ \\t]*(?:\\r?\\n|$)|$)', 1), '\\r?\\n'), lambda l: regexp_matches(l, '^[A-Za-z][A-Za-z-]*:\\s'))"
_EML = f"len({_HEADERS}) >= 3 AND len(list_filter({_HEADERS}, lambda l: regexp_matches(l, '(?i)^From:'))) > 0 AND len(list_filter({_HEADERS}, lambda l: regexp_matches(l, '(?i)^(To|Subject|Received):'))) > 0"
_MBOX = "regexp_matches(text, '^From \\S+') AND regexp_matches(text, '(?m)^From:\\s*\\S+') AND regexp_matches(text, '(?m)^(To|Subject|Date):\\s*\\S+')"


def d10_looks_like_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", detect.looks_like_markdown(F.col("text")).alias("is_markdown"))


def d11_looks_like_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", detect.looks_like_csv(F.col("text")).alias("is_csv"))


def d12_looks_like_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail(read(spark, sf_dir, "orders")).select("o_orderkey", detect.looks_like_mail(F.col("text")).alias("is_mail"), detect.looks_like_mailbox(F.col("text")).alias("is_mailbox"))


def d1_text_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail(read(spark, sf_dir, "orders")).select("o_orderkey", "name", detect.text_format(F.col("text"), F.col("name")).alias("format"))


def d2_format_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = _mail(read(spark, sf_dir, "orders"))
    return mails.groupBy("name", detect.format_by_extension(F.col("name")).alias("format")).agg(F.count("*").alias("n"))


def d14_looks_like_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    t = F.concat(F.lit('{"nbformat'), F.when(k % 4 == 0, "_").otherwise(""), F.lit('": 4, "'), F.when(k % 3 == 0, "cells").when(k % 3 == 1, "worksheets").otherwise("rows"), F.lit('": '), F.when(k % 5 == 0, "1").otherwise(F.concat(F.lit("["), "props", F.lit("]"))), F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", detect.looks_like_notebook(t).alias("is_notebook"))


def d18_declared_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", detect.declared_charset(F.col("html")).alias("charset"))


def p12_blocked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    address = F.concat_ws(".", *((F.pmod(k * m + a, F.lit(n))).cast("string") for m, a, n in ((7919, 10, 260), (104729, 88, 256), (1299709, 2, 256), (15485863, 1, 256))))
    return read(spark, sf_dir, "events").select("event_id", address.alias("address")).select("event_id", "address", detect.blocked_ipv4(F.col("address")).alias("blocked"))


def p13_unsafe_archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?:/(/m)?", "")
    return read(spark, sf_dir, "pages").select("page_id", detect.unsafe_archive_path(path).alias("unsafe"), text.base_name(path).alias("base"), text.safe_filename(text.base_name(path)).alias("safe"))


def f2_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.csv_cell(F.coalesce("text", F.lit(""))), 256).alias("cell_sha256"))


def f3_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("escaped_sha256"))


def f9_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.text_length(F.col("html")).cast("long").alias("chars"))


def f18_needs_reformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.needs_reformat(F.col("text")).alias("needs"))


def c10_text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = F.posexplode(text.split_records(F.col("text"))).alias("record", "bytes")
    return read(spark, sf_dir, "documents").select("doc_id", records).select("doc_id", "record", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))


def r1_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.posexplode(text.blocks("text")).alias("pos", "block")
    return read(spark, sf_dir, "documents").select("doc_id", blocks).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max(F.length("block")).cast("long").alias("longest"))


def a13_line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.line_shapes(rows, detect.CODE_TELL).withColumnRenamed("doc", "doc_id")


def m1_typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    v = F.when(k % 6 == 0, (k * 7919 % 100003).cast("string")).when(k % 6 == 1, F.concat(F.lit("0"), k)).when(k % 6 == 2, F.concat(k, F.lit("."), k % 100)).when(k % 6 == 3, F.concat(F.lit("-"), k % 50)).when(k % 6 == 4, F.concat((k % 9 + 1), F.lit("e+"), k % 40)).otherwise(F.col("event_type"))
    return e.select(k, v.alias("v")).select("event_id", "v", numbers.is_typed(F.col("v")).alias("typed"), numbers.is_numeric(F.col("v")).alias("numeric"))


def m4_column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", numbers.column_letters(F.col("p_partkey") % 16384).alias("letters"))


def m5_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")))
    return read(spark, sf_dir, "part").select("p_partkey", colour.alias("colour"), F.round(numbers.luminance(colour), 6).alias("luminance"))


def t4_mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", text.mail_date("o_orderdate").alias("date"))


def t1_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", text.clock("value").alias("clock"))


def d23_allowed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = F.array(*(F.lit(f) for f in ("md", "csv", "image", "metafile", "html", "docx")))
    inputs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.element_at(formats, (F.col("o_orderkey") * 31 % 6 + 1).cast("int")).alias("format"))
    found = sequences.allowed_targets(inputs, {"image": detect.PICTURE_TARGETS, "svg": detect.PICTURE_TARGETS, "metafile": detect.DRAWING_TARGETS}, detect.TARGETS)
    return found.select(F.col("group").alias("custkey"), F.array_join(F.array_sort("targets"), ",").alias("targets"))


def x14_data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = text.data_uri("text/plain", F.encode("text", "UTF-8"))
    back = F.decode(text.data_of_uri("uri"), "UTF-8")
    return read(spark, sf_dir, "benchmark").select("item_id", uri.alias("uri")).select("item_id", "uri", back.alias("text"))


def x15_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_key("1", "role", "text").alias("key"))


def a7_nested_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return jsontext.nested_share(fields, ["event_type"], "v")


def p3_speaker_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit("<!-- notes: say it slowly\nand twice -->")).otherwise(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", noted.alias("t")).select("conv_id", "turn", text.has_speaker_notes("t").alias("has_notes"), text.without_speaker_notes("t").alias("clean"))


def p9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href")
    return read(spark, sf_dir, "pages").select("page_id", links).select("page_id", "pos", "href", (~F.col("href").rlike("^(?i)(https?|mailto):")).alias("local"))


QUERIES = {f.__name__: f for f in (
    d1_text_format, d2_format_by_extension, d10_looks_like_markdown, d11_looks_like_csv, d12_looks_like_mail, d14_looks_like_notebook, d18_declared_charset, p3_speaker_notes, p9_links,
    p12_blocked_addresses, p13_unsafe_archive_paths, f2_csv_cells, f3_escaped, f9_text_length, f18_needs_reformat, c10_text_records, r1_text_blocks, a13_line_shapes, m1_typed_cells, m4_column_letters,
    m5_luminance, t4_mail_dates, t1_clock, d23_allowed_targets, x14_data_uris, x15_cache_keys, a7_nested_share,
)}
_L = lambda n: f"chr(CAST(65 + {n} AS INT))"
ORACLE_SQL = {
    "d10_looks_like_markdown": f"SELECT doc_id, {_MD} AS is_markdown FROM documents",
    "d11_looks_like_csv": f"SELECT doc_id, {_CSV} AS is_csv FROM documents",
    "d12_looks_like_mail": f"WITH {_MAIL} SELECT o_orderkey, {_EML} AS is_mail, {_MBOX} AS is_mailbox FROM mail",
    "d1_text_format": f"WITH {_MAIL}, f AS (SELECT *, {_FORMAT} AS f FROM mail) SELECT o_orderkey, name, CASE WHEN f = 'vcard' THEN 'txt' WHEN f IS NOT NULL THEN f WHEN {_MBOX} THEN 'mbox' WHEN {_EML} THEN 'eml' WHEN {_MD} THEN 'md' WHEN {_CSV} THEN 'csv' ELSE 'txt' END AS format FROM f",
    "d2_format_by_extension": f"WITH {_MAIL} SELECT name, {_FORMAT} AS format, count(*) AS n FROM mail GROUP BY ALL",
    "d14_looks_like_notebook": "SELECT event_id, event_id % 4 <> 0 AND event_id % 3 < 2 AND event_id % 5 <> 0 AS is_notebook FROM events",
    "d18_declared_charset": r"""SELECT page_id, lower(regexp_extract(html[1:1024], '(?i)<meta[^>]+charset\s*=\s*["'']?\s*([a-z0-9_:.-]+)', 1)) AS charset FROM pages""",
    "p3_speaker_notes": r"""SELECT conv_id, turn, regexp_matches(t, '(?i)<!--\s*notes:') AS has_notes, regexp_replace(t, '(?is)<!--\s*notes:.*?-->', '', 'g') AS clean FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN '<!-- notes: say it slowly' || chr(10) || 'and twice -->' ELSE '' END AS t FROM conversations)""",
    "p9_links": """SELECT page_id, pos, href, NOT regexp_matches(href, '^(?i)(https?|mailto):') AS local FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS pos FROM pages)""",
    "p12_blocked_addresses": """SELECT event_id, a || '.' || b || '.' || c || '.' || d AS address, NOT (a <= 255 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
 OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)) OR (b = 88 AND c = 99))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113))) AS blocked
FROM (SELECT event_id, (event_id * 7919 + 10) % 260 AS a, (event_id * 104729 + 88) % 256 AS b, (event_id * 1299709 + 2) % 256 AS c, (event_id * 15485863 + 1) % 256 AS d FROM events)""",
    "p13_unsafe_archive_paths": r"""SELECT page_id, regexp_matches(p, '^[/\\]|^[A-Za-z]:') OR list_contains(regexp_split_to_array(p, '[/\\]'), '..') AS unsafe, b AS base,
 CASE WHEN s = '' THEN '_' WHEN regexp_matches(lower(s), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$') THEN '_' || s ELSE s END AS safe
FROM (SELECT *, regexp_replace(regexp_replace(b, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[. ]+$', '', 'g') AS s FROM (SELECT *, regexp_split_to_array(p, '[/\\]')[-1] AS b FROM (SELECT page_id, regexp_replace(url, '^https?:/(/m)?', '') AS p FROM pages)))""",
    "f2_csv_cells": """SELECT doc_id, sha256(CASE WHEN regexp_matches(t, '[",\\n\\r]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END) AS cell_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "f3_escaped": """SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_sha256 FROM pages""",
    "f9_text_length": r"""SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '<[^>]*>', '', 'g'), '&[#\w]+;', 'x', 'g'), '\s+', '', 'g')) AS chars FROM pages""",
    "f18_needs_reformat": r"""SELECT doc_id, (length(text) > 200 AND len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_full_match(l, '\s*'))) <= 2) OR len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 500)) > 0 AS needs FROM documents""",
    "c10_text_records": """SELECT doc_id, CAST(i AS INT) AS record, CAST(least(4096, strlen(text) - i * 4096) AS BIGINT) AS size, sha256(unhex(hex(text)[i * 8192 + 1:(i + 1) * 8192])) AS sha256 FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(strlen(text) / 4096) AS BIGINT)))) AS i FROM documents)""",
    "r1_text_blocks": r"""SELECT doc_id, count(*) AS blocks, max(length(b)) AS longest FROM (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '')) AS b FROM documents) GROUP BY doc_id""",
    "a13_line_shapes": rf"""SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(l, '[.!?]$')) AS prose, count(*) FILTER (WHERE regexp_matches(l, '^\s*[-*#>|]')) AS marked, count(*) FILTER (WHERE regexp_matches(l, '{detect.CODE_TELL}')) AS code FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id""",
    "m1_typed_cells": rf"""SELECT event_id, v, v <> '' AND length(v) <= 15 AND ((regexp_matches(v, '{numbers.CANONICAL}') AND NOT regexp_matches(v, '{numbers.TINY}')) OR regexp_matches(v, '{numbers.EXPONENT}')) AS typed, regexp_matches(replace(v, ',', ''), '{numbers.NUMERIC}') AS numeric
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id * 7919 % 100003 AS VARCHAR) WHEN 1 THEN '0' || event_id WHEN 2 THEN event_id || '.' || event_id % 100 WHEN 3 THEN '-' || event_id % 50 WHEN 4 THEN (event_id % 9 + 1) || 'e+' || event_id % 40 ELSE event_type END AS v FROM events)""",
    "m4_column_letters": f"SELECT p_partkey, CASE WHEN n < 26 THEN {_L('n')} WHEN n < 702 THEN {_L('n // 26 - 1')} || {_L('n % 26')} ELSE {_L('(n - 702) // 676')} || {_L('(n - 702) // 26 % 26')} || {_L('n % 26')} END AS letters FROM (SELECT p_partkey, p_partkey % 16384 AS n FROM part)",
    "m5_luminance": """SELECT p_partkey, colour, round(0.2126 * l1 + 0.7152 * l2 + 0.0722 * l3, 6) AS luminance FROM (SELECT p_partkey, '#' || lpad(lower(printf('%x', k)), 6, '0') AS colour,
 """ + ", ".join(f"CASE WHEN c{i} <= 0.04045 THEN c{i} / 12.92 ELSE pow((c{i} + 0.055) / 1.055, 2.4) END AS l{i}" for i in (1, 2, 3)) + " FROM (SELECT p_partkey, k, (k // 65536) / 255 AS c1, (k // 256 % 256) / 255 AS c2, (k % 256) / 255 AS c3 FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS k FROM part)))",
    "t4_mail_dates": "SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS date FROM orders",
    "t1_clock": "SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS s FROM events)",
    "d23_allowed_targets": "WITH i AS (SELECT o_custkey AS custkey, (['md', 'csv', 'image', 'metafile', 'html', 'docx'])[o_orderkey * 31 % 6 + 1] AS f FROM orders) SELECT custkey, CASE WHEN bool_or(f = 'image') THEN '" + ",".join(sorted(detect.PICTURE_TARGETS)) + "' WHEN bool_or(f = 'metafile') THEN '" + ",".join(sorted(detect.DRAWING_TARGETS)) + "' ELSE '" + ",".join(sorted(detect.TARGETS)) + "' END AS targets FROM i GROUP BY custkey",
    "x14_data_uris": "SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS uri, text FROM benchmark",
    "x15_cache_keys": "SELECT conv_id, turn, sha256('1' || chr(10) || role || chr(10) || text) AS key FROM conversations",
    "a7_nested_share": r"""SELECT event_type, count(*) AS fields, count(*) FILTER (WHERE regexp_matches(v, '^\s*[\[{]')) AS nested, count(*) FILTER (WHERE regexp_matches(v, '^\s*[\[{]')) * 10 <= count(*) AS is_table FROM (SELECT event_type, unnest(list_transform(json_keys(props), lambda k: json_extract_string(props, '$."' || k || '"'))) AS v FROM events) GROUP BY event_type""",
}
