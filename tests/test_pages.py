"""Pages as nodes, against the shapes that readers of web pages must get right."""

import pytest
from pyspark.sql import functions as F

from quire.functions import url
from quire.operators import pages
from quire.sources.nodes import nodes


def node_rows(spark, *html):
    return nodes(spark.createDataFrame([(k, h) for k, h in enumerate(html)], "doc long, html string"))


def rewritten(spark, rewrite, *html):
    got = {r.doc: r.html for r in pages.written(rewrite(node_rows(spark, *html))).collect()}
    return [got.get(str(k), "") for k in range(len(html))]


def test_nodes(spark):
    rows = node_rows(spark, "<ul><li>a<li>b</ul>c", None, "", "<p>x<div>y</p>z", "<a><b>").orderBy("doc", "id").collect()
    assert [(r.doc, r.id, r["last"], r.parent, r.name, r.text) for r in rows] == [
        ("0", 0, 4, None, "ul", None), ("0", 1, 2, 0, "li", None), ("0", 2, 2, 1, None, "a"), ("0", 3, 4, 0, "li", None), ("0", 4, 4, 3, None, "b"), ("0", 5, 5, None, None, "c"),
        ("3", 0, 1, None, "p", None), ("3", 1, 1, 0, None, "x"), ("3", 2, 4, None, "div", None), ("3", 3, 3, 2, None, "y"), ("3", 4, 4, 2, None, "z"), ("4", 0, 1, None, "a", None), ("4", 1, 1, 0, "b", None),
    ]


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 10_000 + "x"
    got = rewritten(spark, lambda n: n, deep, "<p", "a < b", "<b title=\"x>bold</b>", "<!-- open", "<script>if (a<b) '</p>'</script>", "<td>1<td>2")
    assert got == [deep + "</div>" * 10_000, "&lt;p", "a &lt; b", '<b title="" &quot;x="">bold</b>'.replace("&quot;x", '"x'), "", "<script>if (a<b) '</p>'</script>", "<td>1</td><td>2</td>"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<p>a<span class="ms-hidden">b</span></p>', "<p>a</p>"),
        ('<p>a<span class="ms-dialogHidden">b</span></p>', '<p>a<span class="ms-dialogHidden">b</span></p>'),
        ('<div style="display:none">x</div>y', "y"),
        ('<div style="display:none"><p>1</p><p>2</p></div>', '<div style="display:none"><p>1</p><p>2</p></div>'),
        ('<div style="DISPLAY : none"><p>1</p></div>z', "z"),
        ("<table hidden><tr><td>1</td></tr></table>", '<table hidden=""><tr><td>1</td></tr></table>'),
        ('<div hidden><div aria-hidden="true"><h1>no</h1></div><h2>yes</h2></div>', '<div hidden=""><h2>yes</h2></div>'),
        ('<div hidden="until-found">x</div>', '<div hidden="until-found">x</div>'),
        ('<i style="width: 1px; height: 1px; clip: rect(0 0 0 0)"><h1>h</h1></i>k', "k"),
        ('<i style="overflow:hidden">k</i>', '<i style="overflow:hidden">k</i>'),
    ],
)
def test_hidden(spark, html, want):
    assert rewritten(spark, pages.visible, html) == [want]


def test_pictures_beside_their_label(spark):
    got = rewritten(
        spark, pages.resolvable_pictures,
        '<a href="x"><img src="i.png" alt="Share"><span> share</span> it</a>', '<a href="x"><img src="i.png" alt="Share">Send</a>', '<p>Share <img src="i.png" alt="Share"></p>',
        '<button><img alt="go" src=""><a> Go on</a></button>', '<img src="data:image/png;base64,AA">',
    )
    assert got == ['<a href="x"><span> share</span> it</a>', '<a href="x"><img alt="Share" />Send</a>', '<p>Share <img alt="Share" /></p>', "<button><a> Go on</a></button>", '<img src="data:image/png;base64,AA" />']


def test_allowed(spark):
    got = rewritten(
        spark, pages.allowed, "<title>t</title><b>x</b>", '<a href="data:text/html,x">a</a>', '<mark style="background: #0F0 none">g</mark>', '<code class="math-display x language-math">c</code>', "<p>\x08a&#11;b</p>",
        '<a href="//x.y/z">r</a>', '<pre class="k"><code class="language-mermaid">g</code></pre>', '<pre class="k"> <code class="language-mermaid">g</code></pre>',
    )
    assert got == [
        "<b>x</b>", "<a>a</a>", '<mark style="background-color:#00FF00">g</mark>', '<code class="language-math math-display">c</code>', "<p>ab</p>", '<a href="//x.y/z">r</a>',
        '<pre><code class="language-mermaid">g</code></pre>', '<pre class="k"> <code class="language-mermaid">g</code></pre>',
    ]


def test_resolved(spark):
    base = "http://A.b/c/d;p?q"
    cases = {  # the examples of RFC 3986, section 5.4
        "g": "http://a.b/c/g", "./g": "http://a.b/c/g", "g/": "http://a.b/c/g/", "/g": "http://a.b/g", "//g": "http://g/", "?y": "http://a.b/c/d;p?y", "g?y": "http://a.b/c/g?y", "#s": "http://a.b/c/d;p?q#s", "g#s": "http://a.b/c/g#s",
        "": "http://a.b/c/d;p?q", ".": "http://a.b/c/", "./": "http://a.b/c/", "..": "http://a.b/", "../g": "http://a.b/g", "../../../g": "http://a.b/g", "./g/.": "http://a.b/c/g/", "g/../h": "http://a.b/c/h", "mailto:x": "mailto:x",
        "HTTPS://Q.r": "https://q.r/", "a b%20ç": "http://a.b/c/a%20b%20%C3%A7",
    }
    rows = spark.createDataFrame(list(cases.items()), "href string, want string").withColumn("got", url.resolved(F.col("href"), F.lit(base)))
    assert [r.asDict() for r in rows.where("got is null or got <> want").collect()] == []
    assert rows.select(url.resolved(F.col("href"), F.lit("no base")).alias("x")).where("x is not null").count() == 2
    remote = spark.createDataFrame([(s,) for s in ("ht\ttps://x", "\\\\h\\s", "//h/x", "x.png", "data:a", "file:///a", "file://h/a", "C:\\x.png")], "s string").select(url.is_remote_picture("s").alias("r")).collect()
    assert [r.r for r in remote] == [True, True, True, False, False, False, True, True]


def test_pictures_are_compared_with_their_label_in_one_reading(spark):
    """Pages are read once and their nodes moved once; a control in a control in a table of a third one says what it holds, and no more."""
    plan = pages.written(pages.resolvable_pictures(node_rows(spark, "x")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    got = rewritten(
        spark, pages.resolvable_pictures,
        '<a>one<table><tr><td><a><img alt="one">two<table><tr><td><button><img alt="three"><i>Th</i>ree</button></td></tr></table></a></td></tr></table><img alt="TWO"></a><img alt="one">',
        "<button><a>x<img alt=y></a>y</button><a><img alt=y>z</a>y", "<a><img alt=x></a>x", "<button>s<a><img alt=s></a><a>s<img alt=s></a><img alt=' s '></button>",
    )
    assert got == [
        '<a>one<table><tr><td><a><img alt="one" />two<table><tr><td><button><i>Th</i>ree</button></td></tr></table></a></td></tr></table></a><img alt="one" />',
        '<button><a>x<img alt="y" /></a>y</button><a><img alt="y" />z</a>y', '<a><img alt="x" /></a>x', '<button>s<a><img alt="s" /></a><a>s</a></button>',
    ]
    gone = rewritten(spark, lambda n: pages.resolvable_pictures(pages.without_dead_links(n)), "<a href=x>one</a><a>two<img alt=two><button>s<img alt=s></button></a><p>one<img alt=one></p>", "<button>x<a>y<img alt=y></a></button>")
    assert gone == ['<a href="x">one</a>two<img alt="two" /><button>s<img alt="s" /></button><p>one<img alt="one" /></p>', '<button>xy<img alt="y" /></button>']


def test_what_hidden_elements_hold_is_counted_in_one_reading(spark):
    plan = pages.written(pages.visible(node_rows(spark, "x")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    got = rewritten(
        spark, pages.visible, "<div hidden>a<div hidden><p>1<p>2</div></div>b<div hidden></div><p>c", "<div hidden><div hidden><p>1</div><div hidden><p>2</div></div><h1>d</h1>", "<div hidden><i hidden></i></div><h1 hidden>e</h1><div hidden>f<h1>g</h1></div>",
    )
    assert got == ['<div hidden="">a<div hidden=""><p>1</p><p>2</p></div></div>b<p>c</p>', '<div hidden=""></div><h1>d</h1>', '<div hidden="">f<h1>g</h1></div>']
