"""Votes, patches, lost markers, rescued and wide tables, class names, picture types, links and embedded parts over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import detect, text
from quire.operators import cells, lines, sequences
from quire.operators.ranges import dealt
from quire.plans.common import read

#: Beginnings of files, and what they are: (alone, with 90 bytes behind).
_PICTURES = (
    ("89504E470D0A1A0A", ("image/png", "image/png")),
    ("FFD8FF", ("image/jpeg", "image/jpeg")),
    ("474946383961", ("image/gif", "image/gif")),
    ("474946383861", (None, None)),
    ("524946460000000057454250", ("image/webp", "image/webp")),
    ("424D0000000000000000000000000C000000", (None, "image/bmp")),
    ("424D0000000000000000000000000D000000", (None, None)),
    ("0000001866747970617669660000000061766966", ("image/avif", "image/avif")),
    ("0000001866747970686569630000000068656963", (None, None)),
    ("00000018667479706D696631000000006D69663161766966", ("image/avif", "image/avif")),
    ("000001000100", ("image/x-icon", "image/x-icon")),
    ("000001000000", (None, None)),
    ("4D4D002A00000008", ("image/tiff", "image/tiff")),
    ("01000000" + "00" * 36 + "20454D46", (None, "image/x-emf")),
    ("D7CDC69A", (None, "image/x-wmf")),
    ("010009000003", (None, "image/x-wmf")),
    ("25504446", (None, None)),
)
_LANGUAGES = {"python": "python", "py": "python", "js": "javascript", "html": "xml", "c++": "cpp", "ruby": "ruby"}


def a10_language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as lines; two tells share a word, one needs a line of another kind, one must not stand beside another."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("line"))
    tells = {"urgent": ["1-URGENT", "^F 2-"], "open": [r"^O [1-3]"], "shut": ["^F"], "low": ["5-LOW$", "4-NOT"]}
    return lines.language_votes(rows, tells, requires={"low": "^P"}, excludes={"urgent": "3-MEDIUM"})


def r27_patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a patch: of git, plain with a removed file, with a preamble, or none at all."""
    k, n = F.col("l_orderkey") % 4, F.col("l_linenumber")
    name = F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string"))
    git = F.array(F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.when(n % 2 == 0, "x").otherwise("")), F.lit("--- a/no"), F.lit("+++ b/no"), F.lit("+line"), F.lit(""))
    plain = F.array(F.concat(F.lit("--- a/"), name, F.lit("\t2020-01-01")), F.when(n % 3 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), name, F.lit("y"))), F.lit("-old"))
    orders = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")  # all that follows finds them in place
    rows = orders.select(F.col("l_orderkey").alias("doc"), n.alias("at"), F.when(k == 0, git).when(k == 1, plain).when((k == 2) & (n == 1), F.array(F.lit(" From: a "), F.lit(""))).when(k == 2, plain).otherwise(F.array(F.lit("--- no patch"), F.lit("text"))).alias("ls"))
    once = rows.groupBy("doc", "at").agg(F.min("ls").alias("ls"))
    return lines.patch_files(once.select("doc", "at", F.posexplode("ls")).select("doc", (F.col("at") * 10 + F.col("pos")).alias("n"), F.col("col").alias("line")))


def a14_lost_list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("n"), F.when(F.col("o_orderkey") % 7 == 0, "ends so.").when(F.col("o_orderkey") % 11 == 0, "\tcell").when(F.col("o_orderkey") % 13 == 0, "  ").when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") % 2 == 0), " 1. typed").otherwise(F.col("o_orderpriority")).alias("line"))
    return lines.lost_list_markers(rows)


def j8_rescued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the blocks of a page: every third is a table, an article keeps some of either."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(".  "), F.coalesce("text", F.lit("")), F.lit(" #")).alias("text"))
    tables, prose = turns.where("pos % 3 = 2"), turns.where("pos % 3 <> 2")
    kept = prose.where("pos % 4 <> 0").withColumn("text", F.when(F.col("pos") % 4 == 3, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    articles = kept.unionByName(tables.where("(doc + pos) % 2 = 0")).groupBy("doc").agg(joined.alias("text"))
    return lines.rescued_tables(tables, prose, articles, kept)


def a5_wide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("doc"), F.col("s_suppkey").alias("k"), F.repeat(F.lit("w"), (F.col("s_suppkey") % 7 * 4).cast("int")).alias("w"), "s_name")
    cell = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), v.alias("value")) for i, v in enumerate((F.col("w"), F.col("s_name"), F.col("w"), F.col("w"), F.col("w"))))))
    table = s.select("doc", F.lit(0).alias("table_no"), F.col("k").alias("r"), cell.alias("x")).select("doc", "table_no", "r", "x.c", "x.value")
    lengths = s.groupBy("doc").agg(F.sum(F.length("w") * 6 + 18).alias("chars"))
    return cells.wide_tables_dominate(cells.measures(table), lengths)


def p8_used_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns of a user's events: the second is filled late in some tables, the third never."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "event_id", "event_type").dropDuplicates(["doc", "event_type"]).select("doc", "event_type", (F.ascii("event_type") % 5 + 1).alias("r"))
    body = e.select("doc", "r", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), v.alias("value")) for i, v in enumerate((F.col("event_type"), F.when(F.col("r") >= 3, "x").otherwise(""), F.lit(""), F.col("event_type")))))).alias("x"))
    top = e.select("doc").distinct().select("doc", F.lit(0).alias("r"), F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.lit(f"n{i}").alias("value")) for i in range(4)))).alias("x"))
    table = body.unionByName(top).select("doc", F.lit(0).alias("table_no"), "r", "x.c", "x.value")
    return cells.used_columns(table, shown=3).select("doc", "c", "name")


def f14_class_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ("language-Python", "x highlight-source-c++ y", "highlight-text-html-basic", "brush: js; gutter: false", "brush: none language-py", "ruby", "sourceCode ruby", "hljs none py", "", "lang-none language-ruby")
    css = F.element_at(F.array(*(F.lit(c) for c in cases)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", text.language_from_class(css, _LANGUAGES).alias("language"))


def d5_picture_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures with little or much behind them, some of other files' beginnings."""
    data = F.unhex(F.concat(F.element_at(F.array(*(F.lit(head) for head, _ in _PICTURES)), (F.col("p_partkey") % len(_PICTURES) + 1).cast("int")), F.repeat(F.lit("00"), (F.col("p_partkey") % 2 * 90).cast("int"))))
    return read(spark, sf_dir, "part").select("p_partkey", detect.picture_type(data).alias("mime"), detect.is_heic(data).alias("heic"))


def p11_resolvable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.element_at(F.array(F.lit("HTTPS://x/"), F.lit("c2.xhtml#a"), F.lit("mailto:a@b.c"), F.lit("#here")), (F.col("p_partkey") % 4 + 1).cast("int"))
    html = F.concat(F.lit('<p><a class="x" href="'), target, F.lit('">\n'), "p_name", F.lit('</a> <A name="n"><b>y</b></A><abbr>z</abbr><a\nHREF="http:z">'), "p_type", F.lit("</a></p>"))
    return read(spark, sf_dir, "part").select("p_partkey", text.resolvable_links(html).alias("html"))


def j3_embedded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the parts of a mail, named in either case, and as the pictures that name them."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("name"))
    parts = o.where("k % 3 <> 0").select("doc", F.col("k").alias("part"), F.when(F.col("k") % 2 == 0, F.lower("name")).otherwise(F.col("name")).alias("cid"))
    return sequences.embedded_parts(o.select("doc", F.col("k").alias("pos"), F.when(F.col("k") % 5 == 0, F.lower("name")).otherwise(F.col("name")).alias("cid")), parts)


def w13_admitted_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as pictures of some megabytes in files of unlike sizes."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    pictures = rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), ((F.col("p") * 7919 + F.col("s")) % 7000000).alias("size"), (F.col("l_orderkey") % 5 * 2000000).alias("file_size"))
    return sequences.admitted(pictures).select("doc", "pos", "admitted")


def _notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as marks named by priority, and as notes; some notes end a paragraph, some have no mark."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), F.substring("o_orderpriority", 1, 1).alias("label"), F.length("o_orderpriority").alias("number"))
    notes = o.groupBy("doc", "label").agg(F.min("pos").alias("pos")).select("doc", "label", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("<p>n"), F.col("pos").cast("string"), F.lit("</p>\n"))).otherwise("bare").alias("body"))
    return o.where("pos % 3 = 0"), notes


def h13_note_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, _ = _notes(spark, sf_dir)
    links, epub, plain, texts = (sequences.note_marks(refs, style).withColumn("style", F.lit(style)) for style in ("links", "epub", "plain", "text"))
    return links.unionByName(epub).unionByName(plain).unionByName(texts).select("doc", "pos", "style", "html")


def h13_note_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, notes = _notes(spark, sf_dir)
    links, epub, plain = (sequences.note_items(notes, refs, style).withColumn("style", F.lit(style)) for style in ("links", "epub", "plain"))
    return links.unionByName(epub).unionByName(plain).select("doc", "label", "style", "html")


def p18_picture_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("p_size").cast("string")
    one = F.concat(F.lit('<figure><img src="a" width="'), w, F.lit('px" height=7></figure>'))
    bare = F.lit("<p>&nbsp;<img src=b><!-- note --><br/> </p>")
    html = F.element_at(F.array(one, F.concat(one, F.lit("<hr class=x>"), bare), F.concat(one, F.lit("<hr>")), F.concat(one, F.lit("text")), F.concat(one, one), F.concat(F.lit("<table>"), one), F.lit("")), (F.col("p_partkey") % 7 + 1).cast("int"))
    sizes = text.picture_pages(html)
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.size(sizes), F.lit(-1)).alias("pages"), sizes[0]["width"].cast("int").alias("width"), F.get(sizes, F.lit(1))["width"].cast("int").alias("second"))


QUERIES = {f.__name__: f for f in (a10_language_votes, r27_patch_files, a14_lost_list_markers, j8_rescued_tables, a5_wide_tables, p8_used_columns, f14_class_languages, d5_picture_types, p11_resolvable_links, j3_embedded_parts, w13_admitted_pictures, h13_note_marks, h13_note_items, p18_picture_pages)}

_NOTES = """o AS (SELECT o_custkey AS doc, o_orderkey AS pos, left(o_orderpriority, 1) AS label, length(o_orderpriority) AS number FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, label ORDER BY pos) = 1 AS first FROM o WHERE pos % 3 = 0),
n AS (SELECT doc, label, CASE WHEN min(pos) % 2 = 0 THEN '<p>n' || min(pos) ELSE 'bare' END AS body, min(pos) % 2 = 0 AS p, count(*) FILTER (WHERE pos % 3 = 0) > 0 AS named FROM o GROUP BY doc, label)"""
ORACLE_SQL = {
    "a10_language_votes": """WITH l AS (SELECT o_custkey AS doc, o_orderstatus || ' ' || o_orderpriority AS line FROM orders),
v AS (SELECT doc, count(*) AS lines, CASE WHEN bool_or(contains(line, '3-MEDIUM')) THEN 0 ELSE count(*) FILTER (WHERE contains(line, '1-URGENT') OR line LIKE 'F 2-%') END AS a,
  count(*) FILTER (WHERE line LIKE 'O 1%' OR line LIKE 'O 2%' OR line LIKE 'O 3%') AS b, count(*) FILTER (WHERE line LIKE 'F%') AS c, CASE WHEN bool_or(line LIKE 'P%') THEN count(*) FILTER (WHERE line LIKE '%5-LOW' OR contains(line, '4-NOT')) ELSE 0 END AS d FROM l GROUP BY doc),
u AS (SELECT doc, lines, 'urgent' AS language, a AS votes FROM v UNION ALL SELECT doc, lines, 'open', b FROM v UNION ALL SELECT doc, lines, 'shut', c FROM v UNION ALL SELECT doc, lines, 'low', d FROM v)
SELECT doc, language, votes, lines FROM u WHERE votes >= 2 AND votes * 4 >= lines AND votes >= 2 * (SELECT max(o.votes) FROM u o WHERE o.doc = u.doc AND o.language <> u.language)""",
    "r27_patch_files": r"""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, min('f' || l_partkey % 50) AS f FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) - CASE WHEN doc % 4 = 2 AND bool_or(n = 1) OVER (PARTITION BY doc) THEN 1 ELSE 0 END AS k FROM l WHERE doc % 4 < 3)
SELECT doc, k AS file_no, CASE WHEN k = 0 THEN NULL WHEN doc % 4 = 0 THEN CASE WHEN n % 2 = 0 THEN f || ' → ' || f || 'x' ELSE f END WHEN n % 3 = 0 THEN f ELSE f || 'y' END AS title,
  CASE WHEN k = 0 THEN 'From: a' WHEN doc % 4 = 0 THEN 'diff --git a/' || f || ' b/' || f || CASE WHEN n % 2 = 0 THEN 'x' ELSE '' END || chr(10) || '--- a/no' || chr(10) || '+++ b/no' || chr(10) || '+line'
  ELSE '--- a/' || f || chr(9) || '2020-01-01' || chr(10) || CASE WHEN n % 3 = 0 THEN '+++ /dev/null' ELSE '+++ b/' || f || 'y' END || chr(10) || '-old' END AS body FROM p
WHERE k > 0 OR EXISTS (SELECT 1 FROM p o WHERE o.doc = p.doc AND o.k = 1)""",
    "a14_lost_list_markers": r"""WITH l AS (SELECT o_custkey AS doc, o_orderkey AS n, CASE WHEN o_orderkey % 7 = 0 THEN 's' WHEN o_orderkey % 11 = 0 THEN 't' WHEN o_orderkey % 13 = 0 THEN 'b' WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'm' ELSE 'i' END AS k FROM orders),
g AS (SELECT *, k IN ('m', 'i') AS item, row_number() OVER (PARTITION BY doc ORDER BY n) - row_number() OVER (PARTITION BY doc, k IN ('m', 'i') ORDER BY n) AS island FROM l),
s AS (SELECT doc, count(*) AS items, count(*) FILTER (WHERE k = 'm') AS marked FROM g WHERE item GROUP BY doc, island HAVING count(*) >= 2),
d AS (SELECT doc, count(*) AS stacks, sum(items) AS items, sum(marked) AS marked FROM s GROUP BY doc), f AS (SELECT doc, count(*) FILTER (WHERE k <> 'b') AS filled FROM l GROUP BY doc)
SELECT f.doc, CAST(coalesce(items, 0) AS BIGINT) AS items, CAST(coalesce(marked, 0) AS BIGINT) AS marked, coalesce(stacks >= 3 AND marked * 2 < items AND items >= 0.4 * filled, false) AS lost FROM f LEFT JOIN d ON f.doc = d.doc""",
    "j8_rescued_tables": r"""WITH t AS MATERIALIZED (SELECT conv_id AS doc, turn AS pos, trim(regexp_replace(' ' || turn || '.  ' || coalesce(text, '') || ' #', '\s+', ' ', 'g')) AS x FROM conversations),
k AS (SELECT doc, pos, CASE WHEN pos % 4 = 3 THEN x || ' more' ELSE x END AS x FROM t WHERE pos % 3 <> 2 AND pos % 4 <> 0),
a AS (SELECT doc, string_agg(x, ' ' ORDER BY pos) AS x FROM (SELECT * FROM k UNION ALL SELECT * FROM t WHERE pos % 3 = 2 AND (doc + pos) % 2 = 0) GROUP BY doc),
m AS (SELECT t.doc, t.pos FROM t JOIN a ON t.doc = a.doc WHERE t.pos % 3 = 2 AND NOT contains(a.x, left(t.x, 200))),
b AS (SELECT m.doc, m.pos, (SELECT arg_max(t.x, t.pos) FROM t WHERE t.doc = m.doc AND t.pos < m.pos AND t.pos % 3 <> 2 AND length(t.x) >= 40) AS anchor FROM m)
SELECT b.doc, b.pos, coalesce(min(k.pos) FILTER (WHERE k.x = anchor), min(k.pos) FILTER (WHERE starts_with(k.x, left(anchor, 60)))) AS after_pos FROM b LEFT JOIN k ON b.doc = k.doc GROUP BY b.doc, b.pos""",
    "a5_wide_tables": """WITH s AS (SELECT s_suppkey % 7 AS doc, count(*) AS n, sum(length(s_name)) AS names FROM supplier GROUP BY ALL),
w AS (SELECT doc, n, 4 * greatest(3, least(24, 4 * doc)) + 18 + 15 AS needed, n * 4 * 4 * doc + names AS chars FROM s)
SELECT doc, CAST(CASE WHEN needed > 95 THEN chars ELSE 0 END AS BIGINT) AS wide_chars, needed > 95 AND chars >= 0.5 * n * (24 * doc + 18) AS dominate FROM w""",
    "p8_used_columns": """WITH e AS (SELECT DISTINCT user_id AS doc, ascii(event_type) % 5 + 1 AS r FROM events)
SELECT DISTINCT doc, c, 'n' || c AS name FROM e, unnest([0, 1, 3]) AS u(c) WHERE r <= 3 AND (c <> 1 OR r = 3)""",
    "f14_class_languages": "SELECT p_partkey, ['python', 'cpp', 'xml', 'javascript', NULL, NULL, 'ruby', 'python', NULL, 'ruby'][p_partkey % 10 + 1] AS language FROM part",
    "d5_picture_types": f"""SELECT p_partkey, nullif(m, '') AS mime, heic FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN {[x[1][1] or '' for x in _PICTURES]}[k] ELSE {[x[1][0] or '' for x in _PICTURES]}[k] END AS m, k = 9 AS heic FROM (SELECT p_partkey, p_partkey % {len(_PICTURES)} + 1 AS k FROM part))""",
    "p11_resolvable_links": """SELECT p_partkey, '<p>' || CASE p_partkey % 4 WHEN 0 THEN '<a class="x" href="HTTPS://x/">' || chr(10) || p_name || '</a>' WHEN 2 THEN '<a class="x" href="mailto:a@b.c">' || chr(10) || p_name || '</a>' ELSE chr(10) || p_name END || ' <b>y</b><abbr>z</abbr><a' || chr(10) || 'HREF="http:z">' || p_type || '</a></p>' AS html FROM part""",
    "j3_embedded_parts": """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderpriority AS name FROM orders), p AS (SELECT doc, k AS part, CASE WHEN k % 2 = 0 THEN lower(name) ELSE name END AS cid FROM o WHERE k % 3 <> 0),
r AS (SELECT doc, k AS pos, CASE WHEN k % 5 = 0 THEN lower(name) ELSE name END AS cid FROM o)
SELECT r.doc, pos, r.cid, coalesce(min(part) FILTER (WHERE p.cid = r.cid), min(part)) AS part FROM r LEFT JOIN p ON r.doc = p.doc AND lower(r.cid) = lower(p.cid) GROUP BY r.doc, pos, r.cid""",
    "w13_admitted_pictures": """WITH RECURSIVE p AS MATERIALIZED (SELECT l_orderkey AS doc, l_linenumber AS pos, (min(l_partkey) * 7919 + min(l_suppkey)) % 7000000 + 64 AS cost, greatest(10485760, l_orderkey % 5 * 4000000) AS budget, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber),
t AS (SELECT doc, pos, k, cost <= budget AS admitted, CASE WHEN cost <= budget THEN cost ELSE 0 END AS spent FROM p WHERE k = 1
  UNION ALL SELECT p.doc, p.pos, p.k, spent + cost <= budget, CASE WHEN spent + cost <= budget THEN spent + cost ELSE spent END FROM t JOIN p ON p.doc = t.doc AND p.k = t.k + 1)
SELECT doc, pos, admitted FROM t""",
    "h13_note_marks": f"""WITH {_NOTES} SELECT doc, pos, style, CASE style WHEN 'text' THEN '[' || number || ']' WHEN 'plain' THEN '<sup>' || number || '</sup>' ELSE
  CASE style WHEN 'epub' THEN '<sup><a epub:type="noteref" href="#fn-' ELSE '<sup class="fnref"><a href="#fn-' END || label || '"' || CASE WHEN first THEN ' id="fnref-' || label || '"' ELSE '' END || '>' || number || '</a></sup>' END AS html
FROM r, unnest(['links', 'epub', 'plain', 'text']) AS u(style)""",
    "h13_note_items": f"""WITH {_NOTES} SELECT doc, label, style, CASE style WHEN 'plain' THEN '<li>' WHEN 'links' THEN '<li id="fn-' || label || '">' ELSE '<li id="fn-' || label || '" epub:type="footnote">' END || body ||
  CASE WHEN style <> 'plain' AND named THEN ' <a href="#fnref-' || label || '" class="fnback" aria-label="Back to the text">↩</a>' || CASE WHEN p THEN '</p>' ELSE '' END WHEN p THEN '</p>' || chr(10) ELSE '' END || '</li>' AS html
FROM n, unnest(['links', 'epub', 'plain']) AS u(style)""",
    "p18_picture_pages": "SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE -1 END AS INTEGER) AS pages, CASE WHEN p_partkey % 7 < 2 THEN CAST(p_size AS INTEGER) END AS width, CAST(NULL AS INTEGER) AS second FROM part",
}
