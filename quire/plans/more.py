"""More scalar and record operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import detect, numbers, text
from quire.operators import lines, sequences
from quire.plans.common import read
from quire.sources import records

#: Event numbers to a bucket, so that a user's lines are numbered in parts.
LINES_A_BUCKET = 10_000


def d22_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page holds diagrams or formulas; some paragraphs are marked as such first."""
    k = F.col("page_id")
    html = F.when(k % 4 == 0, F.regexp_replace("html", "<h1>", '<pre><code class="language-mermaid">')).when(k % 4 == 1, F.regexp_replace("html", "<h1>", '<code class="language-math math-display">')).otherwise(F.col("html"))
    return read(spark, sf_dir, "pages").select(k, text.has_diagrams(html).alias("diagrams"), text.has_formulas(html).alias("math"))


#: Ends of file names and the language that each says.
_ENDS = (
    ("b.TS", "typescript"), ("/x/c.py", "python"), (r"\d.KT", "kotlin"), ("e.h", "c"), (".env", "ini"), ("/.env.Local-2", "ini"), ("/Dockerfile", "dockerfile"), (r"\CMakeLists.txt", "cmake"), ("/nginx.conf", "nginx"), (".conf", "ini"),
    (".m", None), (".html", None), ("/constructor", None), (".__proto__", None), ("/Makefile", "makefile"), ("a/Makefile.txt", None), (".tar.patch", "diff"), (".r", "r"), (".toml", "ini"), (".psm1", "powershell"), (".gql", "graphql"),
    (".xslt", "xml"), (".", None), ("", None), (".s", "x86asm"), (".json5", "json"), (".py/", None), ("/a.env.local", None), (".CLJS", "clojure"),
)


def d3_code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of parts' names as file names with many ends."""
    ends = F.array(*[F.lit(e) for e, _ in _ENDS])
    name = F.concat("p_name", F.element_at(ends, (F.col("p_partkey") % len(_ENDS) + 1).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), detect.code_language(name).alias("language"))


def f7_strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    coloured = F.concat(F.lit("\x1b[1;31m"), "role", F.lit("\x1b[0m: "), "text", F.lit("[0m"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_ansi(coloured).alias("plain"))


def f10_dedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    indented = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.concat(F.repeat(F.lit(" "), (i % 3 + 2).cast("int")), l)), "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.dedent(indented), 256).alias("sha256"))


def f23_cell_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", "o_orderstatus", F.lit(" "), "o_orderpriority", F.lit(""), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.cell_boundaries(line).alias("line"))


def m3_sqlite_reals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals as a database prints them, some as large or small as need exponents."""
    x = F.col("o_totalprice") * F.element_at(F.array(*(F.lit(v) for v in (1.0, 1e12, 1e-9, -1.0, 0.0))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.sqlite_real(x).alias("printed"))


def z12_task_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "[ ] ").when(F.col("l_linenumber") % 3 == 1, "[x] ").otherwise("[y] "), "l_returnflag")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.task_item(item).alias("item")).distinct()


def r8b_bad_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a user's properties that are no JSON; every seventh is cut short."""
    e = read(spark, sf_dir, "events").withColumn("line", F.when(F.col("event_id") % 7 == 3, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")))
    dealt = e.select("user_id", "event_id", F.trim("line").alias("line"), F.floor(F.col("event_id") / LINES_A_BUCKET).alias("bucket"))
    counts = dealt.groupBy("user_id", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("user_id", "bucket", (F.sum("n").over(Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("user_id", "bucket").orderBy("event_id")) - 1
    numbered = dealt.withColumn("nth", nth).join(before, ["user_id", "bucket"])
    return numbered.where((F.col("line") != "") & F.try_parse_json("line").isNull()).select("user_id", (F.col("before") + F.col("nth")).cast("int").alias("line_no"))


def r12_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as captions and read back."""
    at = F.col("turn") * 65
    stamp = lambda s: F.format_string("%02d:%02d:%02d.500", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), stamp(at), F.lit(" --> "), stamp(at + 30), F.lit("\n<v "), "role", F.lit(">"), F.regexp_replace("text", r"\n+", " "))
    files = read(spark, sf_dir, "conversations").select("conv_id", "turn", cue.alias("cue")).groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cue"))), lambda x: x["cue"]), "\n\n")).alias("text"))
    found = records.cues(files, "text", "conv_id")
    return found.select(F.col("doc").alias("conv_id"), "cue_no", "start_s", "end_s", "speaker", F.length("text").alias("chars"))


def s3_numbered_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the order of the number in their names, not of the names."""
    parts = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("slide"), F.col("l_linenumber") * 5, F.lit(".xml")).alias("part")).distinct()
    return sequences.numbered_parts(parts, ["l_orderkey"], to="slide")


def g6_contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a brand's page that are entries of a table of contents: a title, leaders and a number, three on a page at least."""
    line = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.lit(" ..... ")).otherwise(" "), F.col("p_size").cast("string"))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", line.alias("line"))
    return lines.contents_lines(rows, "p_brand").select("p_partkey", "contents")


QUERIES = {f.__name__: f for f in (d22_features, d3_code_languages, f7_strip_ansi, f10_dedent, f23_cell_boundaries, m3_sqlite_reals, z12_task_items, r8b_bad_json_lines, r12_cues, s3_numbered_slides, g6_contents_lines)}
ORACLE_SQL = {
    "d3_code_languages": "WITH e AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{e}', {'NULL' if l is None else repr(l)})" for k, (e, l) in enumerate(_ENDS)) + f") t(k, e, l)) SELECT p_partkey, p_name || e AS name, l AS language FROM part JOIN e ON p_partkey % {len(_ENDS)} = k",
    "d22_features": "SELECT page_id, page_id % 4 = 0 AND contains(html, '<h1>') AS diagrams, page_id % 4 = 1 AND contains(html, '<h1>') AS math FROM pages",
    "f7_strip_ansi": "SELECT conv_id, turn, role || ': ' || text AS plain FROM conversations",
    "f10_dedent": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), p AS (SELECT doc_id, i, repeat(' ', CAST(i % 3 + 2 AS BIGINT)) || l AS l FROM l), m AS (SELECT doc_id, min(length(regexp_extract(l, '^[ \\t]*'))) AS m FROM p WHERE trim(l) <> '' GROUP BY doc_id) SELECT doc_id, sha256(string_agg(l[coalesce(m, 0) + 1:], chr(10) ORDER BY i)) AS sha256 FROM p LEFT JOIN m USING (doc_id) GROUP BY doc_id",
    "f23_cell_boundaries": "SELECT o_orderkey, o_orderstatus || ' | ' || o_orderpriority || ' | ' || o_orderkey AS line FROM orders",
    "m3_sqlite_reals": "SELECT o_orderkey, CASE WHEN x = 0 THEN '0.0' WHEN contains(g, '.') THEN g WHEN contains(g, 'e') THEN replace(g, 'e', '.0e') ELSE g || '.0' END AS printed FROM (SELECT o_orderkey, x, format('{:.15g}', x) AS g FROM (SELECT o_orderkey, o_totalprice * ([1.0, 1e12, 1e-9, -1.0, 0.0])[o_orderkey % 5 + 1] AS x FROM orders))",
    "z12_task_items": "SELECT DISTINCT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '☐ ' WHEN 1 THEN '☑ ' ELSE '[y] ' END || l_returnflag AS item FROM lineitem",
    "r8b_bad_json_lines": "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no FROM events) SELECT user_id, line_no FROM n WHERE event_id % 7 = 3",
    "r12_cues": r"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue_no, turn * 65 + 0.5 AS start_s, turn * 65 + 30.5 AS end_s, role AS speaker, length(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS chars FROM conversations",
    "s3_numbered_slides": "SELECT l_orderkey, 'slide' || n * 5 || '.xml' AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS slide FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)",
    "g6_contents_lines": "SELECT p_partkey, p_size % 2 = 0 AND count(*) FILTER (WHERE p_size % 2 = 0) OVER (PARTITION BY p_brand) >= 3 AS contents FROM part",
}
