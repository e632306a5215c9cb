"""Tables on printed pages: wrapped cells, cells that touch, lists and prose."""

import random

from quire.operators import geometry, regions

ITEM = "doc string, page int, n int, text string, x0 double, x1 double, y double, height double, eol boolean"


def printed(rows, per_page=21, width=4.5, room=140):
    """Rows (code, description, group) printed at 36, 92 and 240 points; the description wraps, and runs into the group where less than 7 points part them."""
    out, n = [], 0
    for k, (code, description, group) in enumerate(rows):
        page, y = k // per_page, 0
        if k % per_page == 0:
            top = 800.0
        lines, current = [], ""
        for word in description.split():
            if current and len(f"{current} {word}") * width > room:
                lines.append(current)
                current = word
            else:
                current = f"{current} {word}".strip()
        lines.append(current)
        for j, text in enumerate(lines):
            y = top - 13 * j
            end = 92 + len(text) * width
            items = [(text, 92.0, end)]
            if j == 0:
                items = [(code, 36.0, 36 + len(code) * width), *([(f"{text} {group}", 92.0, 240 + len(group) * width)] if 240 - end < 7 else [*items, (group, 240.0, 240 + len(group) * width)])]
            for i, (t, x0, x1) in enumerate(items):
                out.append(("print", page, n, t, x0, x1, y, 9.0, i == len(items) - 1))
                n += 1
        top -= 13 * len(lines)
    return out


def test_a_long_print_comes_back(spark):
    rng = random.Random(2)
    words = "adhesive caulk sealer joint compound bolt washer metric and for with steel general purpose industrial cleaning agent".split()
    rows = []
    for k in range(409):
        description = rng.choice(words)
        while len(description) < rng.randrange(8, 100):
            description += " " + rng.choice(words)
        rows.append((f"{10_000 + 37 * k}", description[:100].strip(), f"{rng.randrange(100):02d}"))
    found = regions.tables(spark.createDataFrame(printed(rows), ITEM)).collect()
    grid = {}
    for r in found:
        grid.setdefault((r.page, r.region, r.r), {})[r.c] = r.value
    got = {tuple(g.get(c, "") for c in range(3)) for g in grid.values()}
    assert len(grid) >= 408 and len({k[:2] for k in grid}) == 20
    assert len(got & set(rows)) >= 406


def test_lists_and_prose_are_no_tables(spark):
    bullets = [("list", 0, 2 * k + i, t, x, x + 30.0, 800.0 - 13 * k, 9.0, i == 1) for k in range(12) for i, (t, x) in enumerate((("o", 36.0), (f"point {k}", 60.0)))]
    prose = [("prose", 0, 5 * k + i, f"word{i}", 36.0 + 55 * i, 36.0 + 55 * i + 50, 800.0 - 13 * k, 9.0, i == 4) for k in range(40) for i in range(5)]
    two = [("two", 0, 2 * k + i, f"{k}", x, x + 20.0, 800.0 - 13 * k, 9.0, i == 1) for k in range(2) for i, x in enumerate((36.0, 200.0))]
    assert regions.tables(spark.createDataFrame(bullets + prose + two, ITEM)).count() == 0


def test_lines_and_spaces(spark):
    items = [("d", 0, 0, "Code", 10.0, 30.0, 50.0, 9.0, False), ("d", 0, 1, " ", 30.0, 32.0, 50.0, 9.0, False), ("d", 0, 2, "No", 30.2, 40.0, 50.0, 8.0, False), ("d", 0, 3, "", 40.0, 40.0, 50.0, 0.0, True), ("d", 0, 4, "next", 10.0, 20.0, 30.0, 9.0, True), ("d", 0, 5, "  ", 1.0, 2.0, 3.0, 4.0, True)]
    df = spark.createDataFrame(items, ITEM)
    assert [(r.line, r.text, r.y, r.height) for r in regions.lines(df).orderBy("line").collect()] == [(0, "Code No", 50.0, 9.0), (1, "next", 30.0, 9.0)]
    assert [r.text for r in regions.segments(regions.positioned(df)).orderBy("line").collect()] == ["Code No", "next"]


def test_prose_is_left_before_it_is_stored(spark, monkeypatch):
    """Only pages with a gap are written; gaps to the left, over blank items and beside missing places count, and no plan lays a page out twice."""
    kept, plans, stored = [], [], regions.stored
    monkeypatch.setattr(regions, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    monkeypatch.setattr(geometry, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    prose = [("prose", 0, 5 * k + i, f"word{i}", 36.0 + 55 * i, 36.0 + 55 * i + 50, 800.0 - 13 * k, 9.0, i == 4) for k in range(40) for i in range(5)]
    table = [(doc, 0, 3 * k + i, t, x, x + 30.0, 800.0 - 13 * k, 9.0, i == 2) for doc, places in (("right", (36.0, 70.0, 200.0)), ("left", (200.0, 190.0, 36.0))) for k in range(4) for i, (t, x) in enumerate(zip((f"a{k}", " ", f"b{k}"), places, strict=True))]
    found = regions.tables(spark.createDataFrame(prose + table, ITEM))
    assert {(r.doc, r.r, r.c, r.value) for r in found.collect()} == {("right", k, c, f"{'ab'[c]}{k}") for k in range(4) for c in range(2)} | {("left", k, c, f"{'ba'[c]}{k}") for k in range(4) for c in range(2)}
    assert {r.doc for r in kept[0].select("doc").collect()} == {"left", "right"}
    assert all(p.split("Initial Plan")[-1].count("FlatMapGroupsInPandas") <= 1 for p in plans) and len(plans) == 4
