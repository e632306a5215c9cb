"""Pages rewritten over their node table. Each query plants markup at places that every page has, and writes the pages again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pages
from quire.operators.ranges import dealt
from quire.plans.common import read
from quire.sources.nodes import nodes

#: What stands at the head of the article in p1_allowed_pages, and what is left of it.
PLANTED = (
    '<mark STYLE="color:red;background : rgb(18, 52, 86) url(x)">m</mark><mark style="background-color:#FF0">y</mark><font color=red>f<i onclick="x()">i</i></font><img alt=" A &amp; &quot;B&quot; "><img src="cid:1">'
    '<img src="data:image/png;base64,AA==" width=3 alt=\'"\'><pre class="k language-gv"><code class="language-GraphViz">a &lt; b</code></pre><pre class=k><code class="z language-c++ hljs">c</code></pre>'
    '<table><tr><td align=RIGHT colspan=2 style="color:red">r<td style="text-align:justify" align=left>n<th style="text-align: left; text-align:Center !important">c</table><sup data-fn="a b">1</sup><sup data-fn="a.b-1">2</sup>'
    '<a href="java\nscript:alert(1)" title="t">j</a><a href=" mailto:x@y.z" target=_blank>&lt;m&gt;</a><object><p>o</object><textarea><b>not</b></textarea><a title=\'unclosed>odd</a>'
)
LEFT = (
    '<mark style="background-color:#123456;color:#FFFFFF">m</mark><mark>y</mark>f<i>i</i><span>[A &amp; "B"]</span>'
    '<img src="data:image/png;base64,AA==" alt="&quot;" width="3" /><pre><code class="language-dot">a &lt; b</code></pre><pre class="k"><code class="language-c++ hljs">c</code></pre>'
    '<table><tr><td colspan="2" style="text-align:right">r</td><td>n</td><th style="text-align:center">c</th></tr></table><sup>1</sup><sup data-fn="a.b-1">2</sup>'
    '<a title="t">j</a><a href=" mailto:x@y.z">&lt;m&gt;</a><p>o</p><a title="">odd</a>'
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, dealt over many tasks: a page is read for far longer than it takes to move it."""
    return dealt(read(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")


def _hashed(html: DataFrame) -> DataFrame:
    return html.select(F.col("doc").cast("long").alias("page_id"), F.length("html").cast("long").alias("chars"), F.sha2("html", 256).alias("sha256"))


def p1_allowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = _pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<article>"), F.lit("<article>" + PLANTED)))
    return _hashed(pages.written(pages.allowed(nodes(planted, doc="page_id"))))


def r3a_visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menus are hidden from screen readers, adverts from the eye by turns; articles start collapsed, footers can be found."""
    turn = F.col("page_id") % 4
    advert = F.when(turn == 0, '<div class="ad x\tSR-Only">').when(turn == 1, "<div hidden class=ad>").when(turn == 2, '<div class=ad-ms-hidden style="Display : None"><p>').otherwise('<div style="visibility:hidden"><h2></h2>')
    html = F.replace("html", F.lit("<nav>"), F.lit('<nav aria-hidden="true"><h3>head</h3>'))
    html = F.replace(F.replace(html, F.lit('<div class="ad">'), advert), F.lit("<article>"), F.lit('<article style="display:none">'))
    planted = _pages(spark, sf_dir).withColumn("html", F.replace(html, F.lit("<footer>"), F.lit('<footer hidden="until-found"><i style="width:1px; height:1px; overflow:hidden">pixel</i>')))
    return _hashed(pages.written(pages.visible(nodes(planted, doc="page_id"))))


def p10_resolvable_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An icon stands in every link of the menu, which says the same on even pages; headings have pictures of either kind."""
    icon = F.concat(F.lit('$1<img src="/i.png" alt="'), F.when(F.col("page_id") % 2 == 0, "$2").otherwise("Not $2!"), F.lit('">$2</a>'))
    html = F.regexp_replace("html", F.lit('(<a href="[^"]*">)([^<]*)</a>'), icon)
    planted = _pages(spark, sf_dir).withColumn("html", F.replace(html, F.lit("<h1>"), F.lit('<h1><img src=" HTTPS://x/y.png"><img src="y.png" alt=" "><IMG alt=why SRC=why.gif>')))
    return _hashed(pages.written(pages.resolvable_pictures(nodes(planted, doc="page_id"))))


def r5b_absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page, resolved; at the head of the article stand a relative one, a query, a fragment, one of another kind and a dead one."""
    extra = '<a href="../up/./x y?q=é#f">u</a><a href="?k=1">q</a><a href="#here">h</a><a href="MAILTO:a@b">m</a><a href="//Other.Example/./a/../b">o</a><a name=dead>d</a><a href="">e</a>'
    source = _pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<article>"), F.lit("<article>" + extra)))
    made = pages.without_dead_links(pages.absolute_links(nodes(source, doc="page_id"), source.select(F.col("page_id").cast("string").alias("doc"), F.col("url").alias("base"))))
    links = made.where("name = 'a'").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", F.try_element_at("attrs", F.lit("href")).alias("href")))).alias("links"))
    return links.select(F.col("doc").cast("long").alias("page_id"), F.array_join("links.href", " ").alias("links"))


def p9_local_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures by turns of another machine, of a share, of this folder and of the page itself stand before every heading."""
    turn = F.col("page_id") % 5
    src = F.when(turn == 0, "h\nttps://x/y").when(turn == 1, r"\\host\share.png").when(turn == 2, "y.png").when(turn == 3, "data:image/gif;base64,R0").otherwise("file:///tmp/a.gif")
    planted = _pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<h1>"), F.concat(F.lit('<img alt="<a>" src="'), src, F.lit('"><img src="ftp://z"><h1>'))))
    return _hashed(pages.written(pages.without_remote_pictures(nodes(planted, doc="page_id"))))


QUERIES = {f.__name__: f for f in (p1_allowed_pages, r3a_visible_pages, p10_resolvable_pictures, r5b_absolute_links, p9_local_pictures)}


def _text(sql: str) -> str:
    return "'" + sql.replace("'", "''") + "'"


#: The pages as they are written again: comments and declarations gone, the open bold paragraphs closed, references written in one way.
_CANON = r"""p AS (SELECT page_id, url, replace(CASE WHEN suffix(h, '</html>') THEN h ELSE h || '</body></html>' END, '<br>', '<br /></b></p>') AS h FROM (
  SELECT page_id, url, replace(replace(regexp_replace(replace(replace(replace(regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '&', '&amp;'), '<meta charset="utf-8">', '<meta charset="utf-8" />') AS h FROM pages))"""
_OUT = "SELECT page_id, CAST(length(h) AS BIGINT) AS chars, sha256(h) AS sha256 FROM"

ORACLE_SQL = {
    "p1_allowed_pages": rf"""WITH {_CANON}
{_OUT} (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<head>.*</head>', '', 's'), '<article>', chr(1)), '</?(html|body|nav|article|footer)[^>]*>', '', 'g'), ' class="ad"', '', 'g'), chr(1), {_text(LEFT)}) AS h FROM p)""",
    "r3a_visible_pages": rf"""WITH {_CANON}
{_OUT} (SELECT page_id, replace(replace(regexp_replace(regexp_replace(h, '<nav>.*</nav>', '', 's'), '<div class="ad">', CASE WHEN page_id % 4 = 3 THEN '<div style="visibility:hidden"><h2></h2>' ELSE '<div class="ad">' END),
  '<article>', '<article style="display:none">'), '<footer>', '<footer hidden="until-found">') AS h
  FROM (SELECT page_id, CASE WHEN page_id % 4 = 3 THEN h ELSE regexp_replace(h, '<div class="ad">.*?</div>', '', 's') END AS h FROM p))""",
    "p10_resolvable_pictures": rf"""WITH {_CANON}
{_OUT} (SELECT page_id, replace(CASE WHEN page_id % 2 = 0 THEN h ELSE regexp_replace(h, '(<a href="[^"]*">)([^<]*)</a>', '\1<img alt="Not \2!" />\2</a>', 'g') END, '<h1>', '<h1><img src=" HTTPS://x/y.png" /><img alt=" " /><img alt="why" />') AS h FROM p)""",
    "r5b_absolute_links": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+:)//', 1) AS s, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS o, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS t, html FROM pages),
q AS (SELECT *, regexp_replace(CASE WHEN t = '' THEN '/' ELSE t END, '[?#].*$', '') AS path, regexp_replace(t, '#.*$', '') AS unmarked, list_transform(regexp_extract_all(html, '<a href="([^"]*)">', 1), lambda x: replace(replace(replace(replace(url_encode(replace(x, '&amp;', '&')), '%2F', '/'), '%2C', ','), '%3F', '?'), '%26', '&')) AS own FROM p)
SELECT page_id, array_to_string(list_transform(own, lambda x: o || x) || [o || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', '') || CASE WHEN regexp_replace(path, '[^/]*$', '') = '/' THEN '' ELSE '' END || 'up/x%20y?q=%C3%A9#f',
  o || path || '?k=1', '#here', 'MAILTO:a@b', s || '//other.example/b', o || unmarked], ' ') AS links FROM q""",
    "p9_local_pictures": rf"""WITH {_CANON}
{_OUT} (SELECT page_id, replace(h, '<h1>', ['<p><em>[image: &lt;a&gt;]</em></p>', '<p><em>[image: &lt;a&gt;]</em></p>', '<img alt="&lt;a&gt;" src="y.png" />', '<img alt="&lt;a&gt;" src="data:image/gif;base64,R0" />', '<img alt="&lt;a&gt;" src="file:///tmp/a.gif" />'][page_id % 5 + 1] || '<p><em>[image: not included]</em></p><h1>') AS h FROM p)""",
}
