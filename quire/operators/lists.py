"""Lists and styles of word files: inherited properties, numbers of nested lists, and lists that an interruption has cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.stored import stored

#: How many styles a chain follows, and the levels of a list.
MOST_STYLES, LEVELS = 16, 9


def inherited(styles: DataFrame, properties: list[str], most: int = MOST_STYLES) -> DataFrame:
    """(doc, id, chain, *properties) of styles (doc, id, based_on, *properties): each style's own value or that of the nearest style that it is based on.

    A chain has `most` styles, itself included; it ends at a style that is not there or stands in it already. All chains of a
    round grow by one join, and what has ended is joined no more. (doc, id) names a style."""
    own = styles.select("doc", "id", F.array("id").alias("chain"), F.col("based_on").alias("next"), *properties)
    above = stored(styles.select("doc", F.col("id").alias("next"), F.col("based_on").alias("then"), F.lit(True).alias("is_there"), *[F.col(p).alias(f"of_{p}") for p in properties]))
    ended, growing = [], own
    above = above.hint("merge")  # a broadcast would pass the driver in every round
    for _ in range(most - 1):
        joined = stored(growing.join(above, ["doc", "next"], "left"))
        goes = F.coalesce(F.col("is_there") & ~F.array_contains("chain", F.col("next")), F.lit(False))
        ended.append(joined.where(~goes).select("doc", "id", "chain", *properties))
        growing = joined.where(goes).select("doc", "id", F.array_append("chain", F.col("next")).alias("chain"), F.col("then").alias("next"), *[F.coalesce(p, f"of_{p}").alias(p) for p in properties])
        if not growing.limit(1).count():
            break
    else:
        ended.append(growing.select("doc", "id", "chain", *properties))
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def numbered(paragraphs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """paragraphs (doc, pos, list, level) with number: its place among the paragraphs of its list and level since one of a higher level (a smaller number).

    starts (list, level, start) says where a level begins, 1 if nothing is said. Levels from 0 to 8; (doc, pos) names a paragraph."""
    order = Window.partitionBy("doc", "list").orderBy("pos")
    resets = F.array(*[F.max(F.when(F.col("level") < k, F.col("pos"))).over(order) for k in range(LEVELS)])
    since = paragraphs.withColumn("_since", F.get(resets, F.col("level")))
    nth = F.row_number().over(Window.partitionBy("doc", "list", "level", "_since").orderBy("pos"))
    counted = since.withColumn("_nth", nth).drop("_since")
    if starts is None:
        return counted.withColumnRenamed("_nth", "number")
    joined = counted.join(starts.select("list", "level", "start"), ["list", "level"], "left")
    return joined.withColumn("number", (F.col("_nth") - 1 + F.coalesce("start", F.lit(1))).cast("int")).select(*paragraphs.columns, "number")


def rejoined(lists: DataFrame) -> DataFrame:
    """(doc, n, parts, html): lists of a document (doc, n, tag, first_id, last_id, inner, after) with those that were cut put together under the number of the first.

    inner is what stands between a list's tags, after is the markup between it and the next list. A list goes on in the next if both are
    ordered, the paragraph that ends it is the one that begins the other's number (last_id = first_id), and it ends with an item; what stood
    between them belongs to that item. What follows a list that does not go on stays behind it."""
    order = Window.partitionBy("doc").orderBy("n")
    goes_on = (F.col("tag") == "ol") & (F.lead("tag").over(order) == "ol") & (F.col("last_id") == F.lead("first_id").over(order)) & F.col("inner").rlike(r"</li>\s*$")
    marked = lists.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    begins = ~F.coalesce(F.lag("goes_on").over(order), F.lit(False))
    grouped = marked.withColumn("group", F.sum(begins.cast("int")).over(order))
    between = F.trim(F.coalesce("after", F.lit("")))
    kept = F.when(F.col("goes_on") & (between != ""), F.concat(F.regexp_replace("inner", r"</li>\s*$", ""), between, F.lit("</li>"))).otherwise(F.col("inner"))
    part = F.struct("n", kept.alias("kept"), "tag", F.when(~F.col("goes_on"), F.coalesce("after", F.lit(""))).otherwise("").alias("after"))
    whole = grouped.groupBy("doc", "group").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    tag = F.col("parts")[0]["tag"]
    html = F.concat(F.lit("<"), tag, F.lit(">"), F.array_join("parts.kept", ""), F.lit("</"), tag, F.lit(">"), F.element_at("parts", -1)["after"])
    return whole.select("doc", F.col("parts")[0]["n"].alias("n"), F.size("parts").alias("parts"), html.alias("html"))
