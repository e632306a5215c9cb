"""Rules of texts, tables, names and lists over the driver tables, with hostile values where they matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import detect, text
from quire.operators import cells, sequences
from quire.operators.ranges import dealt
from quire.plans.common import read
from quire.sources import records


def _sha(column: Column) -> Column:
    return F.sha2(column, 256)


def f4_safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" ?"), "p_name", F.lit("! "), F.repeat("p_type", (F.col("p_partkey") % 4).cast("int")), F.lit(" é "))
    raw = F.when(F.col("p_partkey") % 9 == 0, " é? ").otherwise(raw)
    return read(spark, sf_dir, "part").select("p_partkey", text.safe_label(raw).alias("label"))


def f6_sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 9 == 0, "  ").otherwise(F.concat(F.lit("[x] "), "p_type", F.lit("/a*b?:\\"), "p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", text.sheet_name(raw).alias("sheet"))


def f8_contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.lit(" ..... ")).otherwise(F.lit(" .. ")), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", text.contents_entry(line).alias("entry"))


def f12_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 64).otherwise(4096)
    return read(spark, sf_dir, "orders").select("o_orderkey", text.limit_message(F.lit(5000), n).alias("message"), text.blob_label(n).alias("label"))


def r2a_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under front matter with a quoted title, a plain one, none, and under a rule that is no front matter."""
    k = F.col("doc_id") % 4
    head = F.when(k == 0, '---\ntitle: "A \\"b\\" c"\nlang: en\n---\n').when(k == 1, "--- \r\n# note\ntitle: plain x # note\n- item\n...\n").when(k == 2, "---\ntags:\n  - a\n---\n").otherwise("---\nprose without a key!\n---\n")
    found = read(spark, sf_dir, "documents").select("doc_id", text.front_matter(F.concat(head, F.regexp_replace("text", "\r", ""))).alias("m"))
    return found.select("doc_id", F.col("m.title").alias("title"), _sha(F.col("m.body")).alias("sha256"))


def p2_xml_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("\x01\x1f"), F.regexp_replace("text", " ", "\x0b \x08"), F.lit("￾￿"))
    return read(spark, sf_dir, "documents").select("doc_id", _sha(text.strip_xml_illegal(dirty)).alias("sha256"))


def f17_clearly_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    head = F.when(k == 0, "# a heading\n").when(k == 1, "```\ncode\n```\n").when(k == 2, "- item\n> said\n").when(k == 3, "~~~python\n").otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", text.clearly_markdown(F.concat(head, F.regexp_replace("text", r"[#*>\[`~|+-]|[0-9]+[.)]", ""))).alias("markdown"))


def r1a_tab_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a block of tab-separated lines: sound, ragged, with code in it, or indented."""
    k = F.col("o_custkey") % 5
    line = F.concat_ws("\t", F.concat(F.when(k == 3, "\t").otherwise(""), F.col("o_orderkey").cast("string")), F.when(k == 2, "x => y").otherwise(F.col("o_orderstatus")), F.when((k != 1) | (F.col("o_orderkey") % 2 == 0), " 7 "))
    blocks = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("line")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("block"))
    rows = text.tab_rows(F.col("block"), detect.CODE_TELL)
    return blocks.select("o_custkey", F.coalesce(F.size(rows), F.lit(-1)).alias("rows"), F.get(F.get(rows, F.lit(0)), F.lit(2)).alias("third"))


def r6_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as a delimited text (comma, semicolon or tab by brand; quotes, line ends and blank rows in it), read back."""
    mark = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.length("p_type") % 3 + 1).cast("int"))
    quoted = F.concat(F.lit('"'), F.replace(F.concat("p_name", F.lit('\n"'), "p_type", F.lit('",;')), F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat(F.concat_ws("\x00", F.col("p_partkey").cast("string"), quoted, F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 3 == 0, "\n \n").otherwise("\n"))
    rows = read(spark, sf_dir, "part").select("p_type", F.floor(F.col("p_partkey") / 50).alias("part"), "p_partkey", row.alias("row"), mark.alias("mark"))
    texts = rows.groupBy("p_type", "part").agg(F.replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda x: x["row"]), ""), F.lit("\x00"), F.first("mark")).alias("text"))
    found = records.csv_cells(texts.select(F.concat_ws("/", "p_type", F.col("part").cast("string")).alias("doc"), F.concat(F.lit("﻿"), "text").alias("text")))
    return found.select("doc", "r", "c", "value", "error")


def a12_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.shared_alignments(_aligned(spark, sf_dir)).select("doc", "c", "align")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as cells with an alignment; the fourth column is empty below the first row. Orders are dealt before they are cells, so all that follows finds them in place."""
    lines = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), "l_orderkey", parts=500).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    align = F.when(F.col("c") == 0, "right").when((F.col("c") == 1) & (F.col("flag") == "R"), "center").when((F.col("c") == 2) & (F.col("status") == "O"), "left").when(F.col("c") == 3, "center")
    value = F.when(F.col("c") == 1, F.concat("flag", F.lit("|\nx"))).when(F.col("c") == 3, F.when(F.col("l_linenumber") == 1, "top").otherwise("")).otherwise(F.col("status"))
    each = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    return each.select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("table_no"), (F.col("l_linenumber") - 1).alias("r"), "c", ((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 2 == 0)).alias("is_header"), value.alias("value"), align.alias("align"))


def k7a_aligned_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders by the columns' alignments; bars and line ends in cells."""
    table = _aligned(spark, sf_dir)
    return cells.pipe_rows(table, cells.shared_alignments(table)).select("doc", "line_no", "line")


def z2_promoted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _aligned(spark, sf_dir)
    return cells.promoted_headers(table, table.where("doc % 3 = 0").select("doc", "table_no")).select("doc", "r", "c", "is_header")


def a15_auto_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's parts as one table: too many rows for some, too long a word in some, neither in others."""
    p = read(spark, sf_dir, "part")
    row = F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td>"), F.repeat(F.lit("&amp;"), F.when(F.col("p_partkey") % 97 == 0, 29).otherwise(28)), F.lit("</td></tr>"))
    tables = p.select(F.col("p_size").alias("doc"), row.alias("row")).groupBy("doc").agg(F.concat(F.lit('<p>x</p><table class="a">'), F.array_join(F.sort_array(F.collect_list("row")), ""), F.lit("</table>")).alias("html"))
    return tables.select("doc", text.auto_tables(F.col("html")).alias("auto"))


def k2_hostile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects whose names and values hold quotes, backslashes and control characters."""
    s = read(spark, sf_dir, "supplier")
    names = ['say "hi"', "back\\slash", "tab\tkey\x01"]
    values = [F.col("s_suppkey").cast("string"), F.concat(F.lit('"\\\x02\x1f\b\f\r\n'), "s_name"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("string")).otherwise("\x0b")]
    body = s.select(F.col("s_suppkey").alias("doc"), F.explode(F.array(*(F.struct(F.lit(1).alias("r"), F.lit(i).alias("c"), v.alias("value")) for i, v in enumerate(values)))).alias("x"))
    top = s.select(F.col("s_suppkey").alias("doc"), F.explode(F.array(*(F.struct(F.lit(0).alias("r"), F.lit(i).alias("c"), F.lit(n).alias("value")) for i, n in enumerate(names)))).alias("x"))
    table = top.unionByName(body).select("doc", F.lit(0).alias("table_no"), "x.r", "x.c", "x.value")
    return cells.json_rows(table).select("doc", "row")


def w11_taken_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines name a.txt, and the names that those would be given, and the names that those would be given."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    lines = lines.select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("n"))
    given = F.element_at(F.array(*map(F.lit, ("a.txt", "A.txt", "a-2.txt", "a.TXT", "a-2-2.txt", "a-2-3.txt", "a.txt"))), F.col("n"))
    made = sequences.unique_names(lines.withColumn("name", given), ["l_orderkey"], "n")
    return made.select("l_orderkey", "n", "unique_name")


def w11_hostile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that repeat, and given names that are what a repeated one would become."""
    k = F.col("l_linenumber")
    name = F.when(k <= 2, "a.txt").when(k == 3, "A-2.txt").when(k == 4, ".hidden").when(k == 5, ".hidden").when(k == 6, "b.tar.gz").otherwise("B.tar.gz")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", k, name.alias("name")).distinct()
    return sequences.unique_names(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "unique_name")


def j12_cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to anchors of other chapters of a site; a page is in one of three files, and links to itself, to the next page and to nowhere."""
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("doc"), F.col("page_id").alias("pos"), F.concat(F.lit("s"), (F.col("page_id") % 40).cast("string")).alias("anchor"), F.concat(F.lit("c"), (F.col("page_id") % 3).cast("string"), F.lit(".xhtml")).alias("file"))
    link = F.explode(F.array(F.concat(F.lit("#"), "anchor"), F.concat(F.lit("#s"), ((F.col("pos") + 1) % 40).cast("string")), F.lit("#none"), F.lit("http://x/")))
    return sequences.cross_links(p.select("doc", "pos", "file", link.alias("href")), p)


def j13_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th question with the n-th answer of a conversation; conversations with unlike numbers give none."""
    c = read(spark, sf_dir, "conversations")
    sides = [c.where(F.col("role") == role).select("conv_id", "turn", F.length("text").alias("chars")) for role in ("user", "assistant")]
    return sequences.positional(*sides, ["conv_id"], "turn").select("conv_id", "n", "turn", "right_turn", "chars", "right_chars")


def w10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as lines of a page, some further below; lines that end in a hyphen go on."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.col("event_id").alias("n"), F.concat("event_type", F.when(F.col("event_id") % 5 == 0, "-").when(F.col("event_id") % 5 == 1, " -").otherwise("")).alias("text"), (F.lit(10.0) * F.floor(F.col("event_id") / 1000) + F.col("event_id") % 7).alias("y"))
    blocks = sequences.paragraphs(e)
    return sequences.joined_lines(blocks, ["doc", "page", "block"]).select("doc", "block", "n_lines", "text")


def w15_list_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 6 * 2).alias("level"))
    return sequences.rebased_levels(items)


def w17_rejoined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("num_id"))
    return sequences.rejoined_lists(items)


def s7_best_and_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("score"))
    return sequences.best_of(scores, ["o_custkey"], "o_orderpriority", "score").select("o_custkey", "best", "score", F.round("ratio", 6).alias("ratio"))


def u6_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.col("event_type").alias("message"))
    return sequences.distinct_notices(notices).select("doc", F.array_join("messages", "; ").alias("messages"))


def s8_nth_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.length("text").alias("chars"))
    return sequences.nth_part(parts, 4)


def s4_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_type").alias("page"), (F.col("p_partkey") * 7 % 101 + F.col("p_partkey") / 1e6).alias("x0"), F.col("p_size").alias("y"), "p_partkey")
    return sequences.reading_order(items).select("p_partkey", "place")


QUERIES = {
    f.__name__: f
    for f in (
        f4_safe_labels, f6_sheet_names, f8_contents_entries, f12_messages, r2a_front_matter, p2_xml_legal, f17_clearly_markdown, r1a_tab_blocks, r6_csv_cells, a12_alignments, k7a_aligned_pipes, z2_promoted_headers,
        a15_auto_tables, k2_hostile_rows, w11_taken_names, w11_hostile_names, j12_cross_links, j13_positional, w10_paragraphs, w15_list_depths, w17_rejoined_lists, s7_best_and_ratio, u6_notices, s8_nth_part, s4_reading_order,
    )
}

_ALIGNED = """l AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY ALL),
t AS MATERIALIZED (SELECT doc, n - 1 AS r, c, n = 1 AND doc % 2 = 0 AS is_header, CASE c WHEN 1 THEN flag || '|' || chr(10) || 'x' WHEN 3 THEN CASE WHEN n = 1 THEN 'top' ELSE '' END ELSE status END AS value,
  CASE WHEN c = 0 THEN 'right' WHEN c = 1 AND flag = 'R' THEN 'center' WHEN c = 2 AND status = 'O' THEN 'left' WHEN c = 3 THEN 'center' ELSE 'none' END AS align FROM l, unnest([0, 1, 2, 3]) AS u(c)),
al AS MATERIALIZED (SELECT doc, c, nullif(CASE WHEN len(b) = 0 THEN top WHEN len(b) = 1 THEN b[1] END, 'none') AS align FROM (
  SELECT doc, c, coalesce(list(DISTINCT align) FILTER (WHERE r > 0 AND NOT is_header AND value <> ''), []) AS b, max(align) FILTER (WHERE r = 0) AS top FROM t GROUP BY doc, c))"""
ORACLE_SQL = {
    "f4_safe_labels": "SELECT p_partkey, CASE WHEN b = '' THEN 'note' ELSE b END AS label FROM (SELECT p_partkey, left(regexp_replace(regexp_replace(trim(CASE WHEN p_partkey % 9 = 0 THEN ' é? ' ELSE ' ?' || p_name || '! ' || repeat(p_type, p_partkey % 4) || ' é ' END), '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), 56) AS b FROM part)",
    "f6_sheet_names": r"SELECT p_partkey, left(CASE WHEN p_partkey % 9 = 0 THEN 'Sheet' ELSE '_x_ ' || p_type || '_a_b___' || p_name END, 31) AS sheet FROM part",
    "f8_contents_entries": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' — ' || p_size END AS entry FROM part",
    "f12_messages": "SELECT o_orderkey, 'Showing the first 5,000 of ' || format('{:,}', n) || ' records.' AS message, '[blob ' || CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10) || ' MB' END || ']' AS label FROM (SELECT o_orderkey, o_orderkey * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 64 ELSE 4096 END AS n FROM orders)",
    "r2a_front_matter": r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A "b" c' WHEN 1 THEN 'plain x' END AS title, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 4 = 3 THEN sha256('---' || chr(10) || 'prose without a key!' || chr(10) || '---' || chr(10) || replace(text, chr(13), '')) ELSE sha256(replace(text, chr(13), '')) END AS sha256 FROM documents""",
    "p2_xml_legal": r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS sha256 FROM documents",
    "f17_clearly_markdown": r"""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '# a heading' || chr(10) WHEN 1 THEN '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) WHEN 2 THEN '- item' || chr(10) || '> said' || chr(10) WHEN 3 THEN '~~~python' || chr(10) ELSE '' END || regexp_replace(text, '[#*>\[`~|+-]|[0-9]+[.)]', '', 'g') AS t FROM documents)
SELECT doc_id, doc_id % 5 IN (1, 2, 3) OR CAST(regexp_matches(t, '(?m)^#{1,6}[ \t]+\S') AS INT) + CAST(regexp_matches(t, '(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\S') AS INT) >= 2 AS markdown FROM d WHERE t IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
    "r1a_tab_blocks": "SELECT o_custkey, CASE WHEN n >= 2 AND (o_custkey % 5 IN (0, 4) OR (o_custkey % 5 = 1 AND even IN (0, n))) THEN n ELSE -1 END AS rows, CASE WHEN n >= 2 AND (o_custkey % 5 IN (0, 4) OR (o_custkey % 5 = 1 AND even = n)) THEN '7' END AS third FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS even FROM orders GROUP BY o_custkey)",
    "r6_csv_cells": """WITH p AS (SELECT p_type || '/' || CAST(floor(p_partkey / 50) AS BIGINT) AS doc, row_number() OVER (PARTITION BY p_type, floor(p_partkey / 50) ORDER BY p_partkey) - 1 AS r, * FROM part)
SELECT doc, r, 0 AS c, CAST(p_partkey AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM p UNION ALL SELECT doc, r, 1, p_name || chr(10) || '"' || p_type || '",;', NULL FROM p UNION ALL SELECT doc, r, 2, CAST(p_size AS VARCHAR), NULL FROM p""",
    "a12_alignments": f"WITH {_ALIGNED} SELECT doc, c, align FROM al",
    "k7a_aligned_pipes": f"""WITH {_ALIGNED} SELECT doc, CASE WHEN r = 0 THEN 0 ELSE r + 1 END AS line_no, '| ' || string_agg(replace(replace(value, '|', '\\|'), chr(10), '<br>'), ' | ' ORDER BY c) || ' |' AS line FROM t GROUP BY doc, r
UNION ALL SELECT doc, 1, '| ' || string_agg(CASE align WHEN 'left' THEN ':---' WHEN 'center' THEN ':---:' WHEN 'right' THEN '---:' ELSE '---' END, ' | ' ORDER BY c) || ' |' FROM al GROUP BY doc""",
    "z2_promoted_headers": f"WITH {_ALIGNED} SELECT doc, r, c, is_header OR (r = 0 AND doc % 3 = 0 AND doc % 2 = 1) OR (r = 0 AND doc % 3 = 0 AND NOT bool_or(is_header) OVER (PARTITION BY doc)) AS is_header FROM t",
    "a15_auto_tables": "SELECT p_size AS doc, count(*) <= 500 AND count(*) FILTER (WHERE p_partkey % 97 = 0) = 0 AND max(length(w)) <= 28 AS auto FROM (SELECT p_size, p_partkey, CASE WHEN p_partkey % 97 = 0 THEN repeat('w', 58) ELSE '' END AS x, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_size",
    "k2_hostile_rows": r"""SELECT s_suppkey AS doc, '{"say \"hi\"": ' || s_suppkey || ', "back\\slash": "\"\\\u0002\u001f\b\f\r\n' || s_name || '", "tab\tkey\u0001": ' || CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '"\u000b"' END || '}' AS row FROM supplier""",
    "w11_taken_names": """
WITH l AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), h AS (SELECT *, max(n) OVER (PARTITION BY l_orderkey) AS m FROM l)
SELECT l_orderkey, n, CASE n WHEN 1 THEN 'a.txt' WHEN 2 THEN CASE WHEN m < 3 THEN 'A-2.txt' WHEN m < 5 THEN 'A-2-2.txt' WHEN m < 6 THEN 'A-2-3.txt' ELSE 'A-2-4.txt' END
  WHEN 3 THEN 'a-2.txt' WHEN 4 THEN 'a-3.TXT' WHEN 5 THEN 'a-2-2.txt' WHEN 6 THEN 'a-2-3.txt' ELSE 'a-4.txt' END AS unique_name FROM h""",
    "w11_hostile_names": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), h AS (SELECT *, bool_or(n = 1) OVER w AS h1, bool_or(n = 3) OVER w AS h3, bool_or(n = 4) OVER w AS h4, bool_or(n = 6) OVER w AS h6 FROM l WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, n AS l_linenumber, CASE n WHEN 1 THEN 'a.txt' WHEN 2 THEN CASE WHEN h1 AND h3 THEN 'a-2-2.txt' WHEN h1 THEN 'a-2.txt' ELSE 'a.txt' END WHEN 3 THEN 'A-2.txt' WHEN 4 THEN '.hidden' WHEN 5 THEN CASE WHEN h4 THEN '.hidden-2' ELSE '.hidden' END WHEN 6 THEN 'b.tar.gz' ELSE CASE WHEN h6 THEN 'B.tar-2.gz' ELSE 'B.tar.gz' END END AS unique_name FROM h",
    "j12_cross_links": """WITH p AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS doc, page_id AS pos, 's' || page_id % 40 AS anchor, 'c' || page_id % 3 || '.xhtml' AS file FROM pages),
l AS (SELECT doc, pos, file, '#' || anchor AS href FROM p UNION ALL SELECT doc, pos, file, '#s' || (pos + 1) % 40 FROM p UNION ALL SELECT doc, pos, file, '#none' FROM p UNION ALL SELECT doc, pos, file, 'http://x/' FROM p),
a AS (SELECT doc, anchor, arg_max(file, pos) AS f FROM p GROUP BY ALL) SELECT l.doc, pos, file, href, CASE WHEN f <> file THEN f || href ELSE href END AS resolved FROM l LEFT JOIN a ON l.doc = a.doc AND l.href = '#' || a.anchor""",
    "j13_positional": """WITH c AS (SELECT conv_id, role, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS u, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations)
SELECT x.conv_id, x.n, x.turn, y.turn AS right_turn, x.chars, y.chars AS right_chars FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.n = y.n AND x.role = 'user' AND y.role = 'assistant' WHERE x.u = x.a""",
    "w10_paragraphs": """WITH e AS (SELECT user_id AS doc, event_id AS n, event_type || CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN ' -' ELSE '' END AS text, 10.0 * floor(event_id / 1000) + event_id % 7 AS y FROM events),
g AS (SELECT *, abs(lag(y) OVER (PARTITION BY doc ORDER BY n) - y) AS gap FROM e), m AS (SELECT doc, list_sort(list(gap) FILTER (WHERE gap > 0)) AS gs FROM g GROUP BY doc),
b AS (SELECT g.doc, n, text, sum(CASE WHEN gap > 1.5 * gs[len(gs) // 2 + 1] THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc ORDER BY n) AS block FROM g JOIN m ON g.doc = m.doc)
SELECT doc, block, count(*) AS n_lines, regexp_replace(string_agg(text || CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]-$') THEN '' ELSE ' ' END, '' ORDER BY n), ' $', '') AS text FROM b GROUP BY doc, block""",
    "w15_list_depths": "SELECT l_orderkey AS doc, l_linenumber AS pos, l_suppkey % 6 * 2 AS level, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 6 * 2) - 1 AS depth FROM lineitem",
    "w17_rejoined_lists": "SELECT o_custkey AS doc, o_orderkey AS pos, o_orderpriority AS num_id, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS number FROM orders",
    "s7_best_and_ratio": "WITH s AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS place FROM s) SELECT o_custkey, max(p) FILTER (WHERE place = 1) AS best, max(n) FILTER (WHERE place = 1) AS score, round(coalesce(max(n) FILTER (WHERE place = 2), 0) / max(n) FILTER (WHERE place = 1), 6) AS ratio FROM k GROUP BY o_custkey",
    "u6_notices": "WITH f AS (SELECT user_id AS doc, event_type AS m, min(event_id) AS pos FROM events GROUP BY ALL) SELECT doc, string_agg(m, '; ' ORDER BY pos) AS messages FROM f GROUP BY doc",
    "s8_nth_part": "WITH n AS (SELECT conv_id AS doc, turn AS pos, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) SELECT doc, pos, chars, CAST(NULL AS VARCHAR) AS error FROM n WHERE k = 4 UNION ALL SELECT DISTINCT doc, NULL, NULL, 'there is no part 4, only ' || total FROM n WHERE total < 4",
    "s4_reading_order": "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey * 7 % 101 + p_partkey / 1e6) AS place FROM part",
}
