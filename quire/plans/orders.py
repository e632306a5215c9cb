"""Ordered operators over conversations, events, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import sequences as S
from quire.plans.common import read


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, tag, text) of the headings and paragraphs of pages; some paragraphs count as lower headings or rules."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<(?:h1|p)>[^<]+"), F.lit(0))).alias("pos", "raw")
    raw = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), found)
    tag = F.when(F.col("raw").startswith("<h1>"), "h1").when(F.col("pos") % 4 == 2, "h2").when((F.col("pos") % 5 == 4) & (F.col("doc") % 3 == 0), "hr").otherwise("p")
    return raw.select("doc", "pos", tag.alias("tag"), F.regexp_replace("raw", "^<(h1|p)>", "").alias("text"))


_BLOCKS = """raw AS (SELECT doc, pos, raw FROM (SELECT page_id AS doc, unnest(regexp_extract_all(html, '(?s)<(?:h1|p)>[^<]+')) AS raw, unnest(range(len(regexp_extract_all(html, '(?s)<(?:h1|p)>[^<]+')))) AS pos FROM pages)),
blocks AS (SELECT doc, pos, CASE WHEN starts_with(raw, '<h1>') THEN 'h1' WHEN pos % 4 = 2 THEN 'h2' WHEN pos % 5 = 4 AND doc % 3 = 0 THEN 'hr' ELSE 'p' END AS tag, regexp_replace(raw, '^<(h1|p)>', '') AS text FROM raw)"""


def w1_speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring cues of one speaker are one paragraph; every third turn is without a name."""
    cues = read(spark, sf_dir, "conversations").withColumn("speaker", F.when(F.col("turn") % 3 == 2, F.lit(None)).when(F.col("conv_id") % 2 == 0, "host").otherwise(F.col("role")))
    return S.joined_text(S.runs(cues, ["conv_id"], "turn", "speaker"), ["conv_id", "run", "speaker"], "turn", "text").select("conv_id", "run", "speaker", F.col("first").alias("first_turn"), "n", F.sha2("text", 256).alias("sha256"))


def w2_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in parts: a new one after a pause of an hour."""
    e = read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    parts = S.gaps(e, ["user_id"], ["at", "event_id"], F.col("at"), F.col("at"), 3600e6)
    return parts.groupBy("user_id", "part").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"))


def w4_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return S.sections(lines, ["doc_id"], "n", F.length("line") < 40).groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def a1_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the pages of one book, each with a head and a foot."""
    d = read(spark, sf_dir, "documents")
    body = F.concat(F.lit("Book of "), "source", F.lit(", page "), "doc_id", F.lit("\n"), "text", F.lit("\n- "), "doc_id", F.lit(" -"))
    lines = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split(body, "\n")).alias("n", "text"))
    return S.running_heads(lines).groupBy("doc", "page").agg(F.count("*").alias("lines"), F.min("n").alias("first"), F.max("n").alias("last"))


def c5_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.slides(_blocks(spark, sf_dir)).groupBy("doc", "slide").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def c6_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chapters(_blocks(spark, sf_dir)).groupBy("doc", "chapter", "title").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def j2_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the menus to headings of the same site."""
    blocks = _blocks(spark, sf_dir).where("tag in ('h1', 'h2')").select("doc", "pos", "text")
    anchors = S.heading_anchors(blocks)
    links = anchors.select("doc", (F.col("pos") + 1000).alias("pos"), F.when(F.col("pos") % 3 == 0, F.initcap("anchor")).when(F.col("pos") % 3 == 1, F.concat("anchor", F.lit("-x"))).otherwise(F.col("anchor")).alias("target"))
    return S.resolve_links(links, anchors)


def j1_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines refer to notes labelled by supplier; suppliers with even keys have one, as has one that no line names."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 5).cast("string").alias("label"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"))
    notes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.posexplode(F.array(F.lit("4"), F.lit("2"), F.lit("0"), F.lit("x"))).alias("pos", "label"))
    return S.footnotes(items, notes)


def w11_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("site"), F.concat(F.regexp_extract("url", "([^/.]+).[^/.]+/[a-z]+/", 1), F.lit(".html")).alias("name"))
    return S.unique_names(names, ["site"], "page_id").select("page_id", "unique_name")


def u1_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("ord"), F.col("role").alias("title"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    return S.merged(parts).select(F.col("group").alias("conv_id"), "title", F.sha2("html", 256).alias("sha256"))


def u2_prefixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("label")).distinct()
    return S.prefixed_labels(labels).select(F.col("group").alias("orderkey"), "ord", "label", "unique_label")


def j5_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a book: lines give the reading order, only orders that are not pending are in the manifest."""
    o = read(spark, sf_dir, "orders")
    order = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("item"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")).alias("spine_pos"))
    manifest = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("item"), F.concat(F.lit("text/"), "o_orderkey", F.lit(".xhtml")).alias("href"))
    return S.spine(manifest, order)


def u5_distinct_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures are stored once: named by the first of equal bytes."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha1("role").alias("sha"))
    return S.distinct_pictures(t, "conv_id", "turn", "sha")


QUERIES = {f.__name__: f for f in (w1_speaker_turns, w2_pauses, w4_sections, a1_running_heads, c5_slides, c6_chapters, j2_resolved_links, j1_footnotes, w11_unique_names, u1_merged, u2_prefixed_labels, j5_spine, u5_distinct_pictures)}
_SLUG = r"replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{M}\p{N}\p{Pc}\- ]', '', 'g'), ' ', '-')"
ORACLE_SQL = {
    "w1_speaker_turns": "WITH c AS (SELECT *, CASE WHEN turn % 3 = 2 THEN NULL WHEN conv_id % 2 = 0 THEN 'host' ELSE role END AS speaker FROM conversations), n AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n) SELECT conv_id, CAST(run AS BIGINT) AS run, speaker, min(turn) AS first_turn, count(*) AS n, sha256(string_agg(text, ' ' ORDER BY turn)) AS sha256 FROM r GROUP BY conv_id, run, speaker",
    "w2_pauses": "WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3600000000 THEN 1 ELSE 0 END AS new FROM events), p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM e) SELECT user_id, CAST(part AS BIGINT) AS part, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS total FROM p GROUP BY user_id, part",
    "w4_sections": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), s AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l) SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY doc_id, section",
    "a1_running_heads": """WITH t AS (SELECT source AS doc, doc_id AS page, string_split('Book of ' || source || ', page ' || doc_id || chr(10) || text || chr(10) || '- ' || doc_id || ' -', chr(10)) AS ls FROM documents),
l AS (SELECT doc, page, unnest(ls) AS text, unnest(range(len(ls))) AS n, len(ls) AS size FROM t), k AS (SELECT *, trim(regexp_replace(text, '[0-9]+', '#', 'g')) AS key FROM l),
c AS (SELECT doc, key, sum(CASE WHEN n < 2 THEN 1 ELSE 0 END + CASE WHEN n >= size - 2 THEN 1 ELSE 0 END) AS hits FROM k GROUP BY ALL), p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc),
f AS (SELECT k.*, pages >= 4 AND hits > pages / 2 AS rep FROM k JOIN c USING (doc, key) JOIN p USING (doc)),
e AS (SELECT *, bool_and(rep) OVER (PARTITION BY doc, page ORDER BY n) AS up, bool_and(rep) OVER (PARTITION BY doc, page ORDER BY n DESC) AS down FROM f)
SELECT doc, page, count(*) AS lines, min(n) AS first, max(n) AS last FROM e WHERE NOT up AND NOT down GROUP BY doc, page""",
    "c5_slides": f"WITH {_BLOCKS}, r AS (SELECT *, CASE WHEN count(*) FILTER (WHERE tag = 'hr') OVER w > 0 THEN 'hr' WHEN count(*) FILTER (WHERE tag = 'h1') OVER w <= 1 AND count(*) FILTER (WHERE tag = 'h2') OVER w >= 2 THEN 'h2' ELSE 'h1' END AS rule FROM blocks WINDOW w AS (PARTITION BY doc)), s AS (SELECT *, sum(CASE WHEN tag = rule THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS section FROM r), d AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY section) AS slide FROM s WHERE NOT (rule = 'hr' AND tag = 'hr')) SELECT doc, slide, count(*) AS n, min(pos) AS first FROM d GROUP BY doc, slide",
    "c6_chapters": f"WITH {_BLOCKS}, r AS (SELECT *, CASE WHEN count(*) FILTER (WHERE tag = 'h1') OVER w >= 2 THEN 'h1' WHEN count(*) FILTER (WHERE tag = 'h2') OVER w >= 2 THEN 'h2' WHEN count(*) FILTER (WHERE tag = 'h1') OVER w = 1 THEN 'h1' ELSE '' END AS level FROM blocks WINDOW w AS (PARTITION BY doc)), s AS (SELECT *, sum(CASE WHEN tag = level THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS section FROM r), d AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY section) AS chapter FROM s) SELECT doc, chapter, CASE WHEN min(section) = 0 THEN 'Start' ELSE coalesce(nullif(max(trim(text)) FILTER (WHERE tag = level), ''), 'Chapter ' || chapter) END AS title, count(*) AS n, min(pos) AS first FROM d GROUP BY doc, chapter",
    "j2_resolved_links": f"WITH {_BLOCKS}, h AS (SELECT doc, pos, text FROM blocks WHERE tag IN ('h1', 'h2')), s AS (SELECT doc, pos, {_SLUG} AS slug FROM h), a AS (SELECT doc, pos, CASE WHEN k > 0 THEN slug || '-' || k ELSE slug END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc, slug ORDER BY pos) - 1 AS k FROM s)), l AS (SELECT doc, pos + 1000 AS pos, CASE pos % 3 WHEN 0 THEN upper(anchor[1]) || lower(anchor[2:]) WHEN 1 THEN anchor || '-x' ELSE anchor END AS target FROM a) SELECT l.doc, l.pos, l.target, coalesce(x.pos, y.pos) AS heading_pos FROM l LEFT JOIN a x ON l.doc = x.doc AND l.target = x.anchor LEFT JOIN a y ON l.doc = y.doc AND lower(l.target) = y.anchor",
    "j1_footnotes": "WITH r AS (SELECT l_orderkey AS doc, CAST(l_suppkey % 5 AS VARCHAR) AS label, min(l_linenumber * 1000000 + l_partkey) AS fr, count(*) AS n FROM lineitem GROUP BY ALL), nt AS (SELECT o_orderkey AS doc, label, pos FROM orders, (VALUES ('4', 0), ('2', 1), ('0', 2), ('x', 3)) v(label, pos)) SELECT doc, label, row_number() OVER (PARTITION BY doc ORDER BY pos IS NULL, fr NULLS LAST, pos) AS number, coalesce(n, 0) AS n_refs, pos IS NOT NULL AS has_note FROM nt FULL JOIN r USING (doc, label)",
    "w11_unique_names": "WITH n AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS site, regexp_extract(url, '([^/.]+).[^/.]+/[a-z]+/', 1) || '.html' AS name FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY site, lower(name) ORDER BY page_id) AS k FROM n) SELECT page_id, CASE WHEN k > 1 AND length(name) > 5 THEN name[1:length(name) - 5] || '-' || k || '.html' WHEN k > 1 THEN name || '-' || k ELSE name END AS unique_name FROM k",
    "u1_merged": """SELECT conv_id, min_by(role, turn) AS title, sha256(string_agg('<h1>' || role || '</h1><p>' || text || '</p>', '<div class="page-break"></div>' ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id""",
    "u2_prefixed_labels": "WITH l AS (SELECT DISTINCT l_orderkey AS orderkey, l_linenumber AS ord, l_returnflag AS label FROM lineitem) SELECT *, CASE WHEN min(ord) OVER (PARTITION BY orderkey, label) < ord THEN 's' || ord || '.' || label ELSE label END AS unique_label FROM l",
    "j5_spine": "SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS spine_pos, o_orderkey AS item, CASE WHEN o_orderstatus <> 'P' THEN 'text/' || o_orderkey || '.xhtml' END AS href, o_orderstatus = 'P' AS missing FROM orders",
    "u5_distinct_pictures": "WITH f AS (SELECT conv_id, sha1(role) AS sha, min(turn) AS first FROM conversations GROUP BY ALL) SELECT conv_id, sha, 'img' || lpad(CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS VARCHAR), 3, '0') AS name FROM f",
}
