"""Lines of texts and blocks of pages: votes for languages, patches cut by file, lost list markers, tables an article lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def language_votes(lines: DataFrame, tells: dict[str, list[str]], requires: dict[str, str] | None = None, excludes: dict[str, str] | None = None) -> DataFrame:
    """(doc, language, votes, lines): the language that the lines (doc, line) of a document clearly point to; documents without one have no row.

    A line votes for each language of which a pattern matches. A language whose `requires` matches no line, or whose `excludes`
    matches one, has no votes. It takes two votes, a quarter of the lines and twice the votes of the next. Languages are summed
    side by side, so that lines combine before the shuffle.
    """
    any_of = lambda patterns: F.coalesce(F.greatest(*(F.col("line").rlike(p) for p in patterns), F.lit(False)), F.lit(False))
    sums = [F.count("*").alias("lines")]
    for k, (language, patterns) in enumerate(tells.items()):
        votes = F.count(F.when(any_of(patterns), 1))
        if language in (requires or {}):
            votes = F.when(F.max(F.col("line").rlike(requires[language])), votes).otherwise(0)
        if language in (excludes or {}):
            votes = F.when(F.max(F.col("line").rlike(excludes[language])), 0).otherwise(votes)
        sums.append(votes.alias(f"v{k}"))
    each = F.array(*(F.struct(F.col(f"v{k}").alias("votes"), F.lit(-k).alias("place"), F.lit(language).alias("language")) for k, language in enumerate(tells)))
    ranked = lines.groupBy("doc").agg(*sums).select("doc", "lines", F.sort_array(each, asc=False).alias("s"))
    best, second = F.col("s")[0], F.coalesce(F.get("s", F.lit(1))["votes"], F.lit(0))
    won = ranked.where((best["votes"] >= 2) & (best["votes"] * 4 >= F.col("lines")) & (best["votes"] >= second * 2))
    return won.select("doc", best["language"].alias("language"), best["votes"].alias("votes"), "lines")


def _patch_path(raw: Column) -> Column:
    return F.regexp_replace(F.trim(F.split(raw, "\t")[0]), "^[ab]/", "")


def patch_files(lines: DataFrame) -> DataFrame:
    """(doc, file_no, title, body) of the lines (doc, n, line) of patches: a row a file, and file_no 0 for what stands before the first, if anything does.

    Documents with a `diff --git` line are cut at those, others where a `---` line comes before a `+++` line; documents with neither give no rows.
    """
    by_line = Window.partitionBy("doc").orderBy("n")
    git = F.max(F.col("line").startswith("diff --git ")).over(Window.partitionBy("doc"))
    old, new = F.regexp_extract("line", "^diff --git a/(.+?) b/(.+)$", 1), F.regexp_extract("line", "^diff --git a/(.+?) b/(.+)$", 2)
    after = F.coalesce(F.lead("line").over(by_line), F.lit(""))
    to = _patch_path(F.substring(F.col("after"), 5, 1 << 30))
    plain = F.when(F.col("line").startswith("--- ") & F.col("after").startswith("+++ "), F.when(to == "/dev/null", _patch_path(F.substring("line", 5, 1 << 30))).otherwise(to))
    title = F.when(F.col("git"), F.when(new != "", F.when(old == new, new).otherwise(F.concat(old, F.lit(" → "), new)))).otherwise(plain)
    marked = lines.withColumn("git", git).withColumn("after", after).withColumn("title", title)
    numbered = marked.withColumn("file_no", F.count("title").over(by_line)).withColumn("any", F.count("title").over(Window.partitionBy("doc")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    files = numbered.where("any > 0").groupBy("doc", "file_no").agg(F.max("title").alias("title"), joined.alias("body"))
    body = F.when(F.col("file_no") == 0, F.regexp_replace("body", r"^\s+|\s+$", "")).otherwise(F.regexp_replace("body", r"\n+$", ""))
    return files.select("doc", "file_no", "title", body.alias("body")).where("file_no > 0 or body <> ''")


def lost_list_markers(lines: DataFrame) -> DataFrame:
    """(doc, items, marked, lost): whether the lines (doc, n, line) of a document look like lists whose automatic markers are gone.

    An item is a line of 1 to 90 characters without a tab that does not end like a sentence; two in a row make a stack. Lists are
    lost where there are three stacks, fewer than half of their items have a typed marker, and they are four tenths of the lines that are not blank.
    """
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    item = ~F.col("line").contains("\t") & F.length("bare").between(1, 90) & ~F.col("bare").rlike("[.;:]$")
    by_line = Window.partitionBy("doc").orderBy("n")
    each = lines.withColumn("bare", bare).withColumn("item", item)
    stacked = F.col("item") & (F.coalesce(F.lag("item").over(by_line), F.lit(False)) | F.coalesce(F.lead("item").over(by_line), F.lit(False)))
    starts = F.col("item") & ~F.coalesce(F.lag("item").over(by_line), F.lit(False)) & F.coalesce(F.lead("item").over(by_line), F.lit(False))
    marks = F.col("bare").rlike(r"^(?:[0-9]{1,3}[.)]|[A-Za-z][.)])\s+\S")
    found = each.select("doc", "bare", stacked.alias("stacked"), starts.alias("starts"), marks.alias("marks"))
    count = lambda c: F.count(F.when(c, 1))
    sums = found.groupBy("doc").agg(count(F.col("starts")).alias("stacks"), count(F.col("stacked")).alias("items"), count(F.col("stacked") & F.col("marks")).alias("marked"), count(F.col("bare") != "").alias("filled"))
    return sums.select("doc", "items", "marked", ((F.col("stacks") >= 3) & (F.col("marked") * 2 < F.col("items")) & (F.col("items") * 10 >= F.col("filled") * 4)).alias("lost"))


def rescued_tables(tables: DataFrame, prose: DataFrame, articles: DataFrame, kept: DataFrame, signature: int = 200, head: int = 60, least: int = 40) -> DataFrame:
    """(doc, pos, after_pos): the tables of a page that its article lost, and the article's block after which each belongs (null: at the end).

    tables (doc, pos, text) and prose (doc, pos, text; blocks outside tables) of the page, articles (doc, text), kept (doc, pos, text; the
    article's blocks). Text is compared with single spaces. A table is lost if the article does not hold its first `signature`
    characters. It stood after the nearest block before it of at least `least` characters; the article's block equal to that one is
    its place, else the first that begins with that one's first `head` characters.
    """
    plain = lambda df: df.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    lost = plain(tables).join(plain(articles).select("doc", F.col("text").alias("article")), "doc").where(~F.contains("article", F.substring("text", 1, signature))).select("doc", "pos", F.lit(None).cast("string").alias("block"))
    blocks = plain(prose).where(F.length("text") >= least).select("doc", "pos", F.col("text").alias("block"))
    before = Window.partitionBy("doc").orderBy("pos", F.col("block").isNull())
    placed = lost.withColumn("lost", F.lit(True)).unionByName(blocks.withColumn("lost", F.lit(False))).withColumn("anchor", F.last("block", ignorenulls=True).over(before)).where("lost")
    texts = plain(kept).select("doc", F.substring("text", 1, head).alias("head"), F.col("pos").alias("at"), F.col("text").alias("kept_text"))
    matched = placed.select("doc", "pos", "anchor", F.substring("anchor", 1, head).alias("head")).join(texts, ["doc", "head"], "left")
    matched = matched.where(F.col("kept_text").isNull() | (F.length("kept_text") >= F.length("head")))
    place = F.min(F.when(F.col("at").isNotNull(), F.struct((F.col("kept_text") != F.col("anchor")).alias("unlike"), F.col("at").alias("at"))))
    return matched.groupBy("doc", "pos").agg(place.alias("p")).select("doc", "pos", F.col("p.at").alias("after_pos"))


def line_shapes(lines: DataFrame, code: str, line: str = "line") -> DataFrame:
    """(doc, n, prose, marked, code): how many filled lines (doc, line) a text has, how many of them end as sentences do, begin with the mark of a list, heading, quotation or table, and match a tell of code."""
    filled = lines.where(F.trim(line) != "")
    share = lambda p: F.sum(F.col(line).rlike(p).cast("int")).alias
    return filled.groupBy("doc").agg(F.count("*").alias("n"), share(r"[.!?]$")("prose"), share(r"^\s*[-*#>|]")("marked"), share(code)("code"))


def contents_lines(lines: DataFrame, page: str = "page", line: str = "line", least: int = 3) -> DataFrame:
    """lines with `contents`: whether a line is an entry of a table of contents, a title, three leaders or more and a number; `least` of them make a page one."""
    marked = lines.withColumn("contents", F.col(line).rlike(r"^\S.*?\s*\.{3,}\s*[0-9]+$"))
    counts = marked.groupBy(page).agg(F.count_if("contents").alias("_entries"))
    return marked.join(counts, page).withColumn("contents", F.col("contents") & (F.col("_entries") >= least)).drop("_entries")
