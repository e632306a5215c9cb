"""What one task or the driver holds, and order among what ties."""

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import cells, lists, sequences
from quire.operators.ranges import dealt
from quire.plans import grids, layouts, pagetrees, pictures, rules
from tests.oracle import SMALL


def test_labels_that_tie_stand_in_their_order(spark):
    refs = spark.createDataFrame([(d, label, 7) for d in range(50) for label in ("3", "1", "2")], "doc long, label string, pos long")
    notes = spark.createDataFrame([(d, "x", 0) for d in range(50)], "doc long, label string, pos int")
    for each in (refs, refs.orderBy("doc", F.desc("label")), refs.orderBy("label")):
        rows = sequences.footnotes(each, notes).where("not has_note").collect()
        assert {(r.label, r.number) for r in rows} == {("1", 2), ("2", 3), ("3", 4)}


def test_dealt_rows_are_not_put_together_again(spark):
    rows = dealt(spark.range(1000), "id").groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert len(rows) > 150 and max(r.n for r in rows) < 30


def test_names_are_dealt(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(sequences, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    names = spark.createDataFrame([(1, 1, "a.txt"), (1, 2, "A.txt"), (1, 3, "a-2.txt")], "k long, n long, name string")
    got = sequences.unique_names(names, ["k"], "n").orderBy("n").collect()
    assert [r.unique_name for r in got] == ["a.txt", "A-2-2.txt", "a-2.txt"]
    assert len(plans) == 1 and plans[0].count("REPARTITION_BY_NUM") == 2


def test_styles_are_not_broadcast(spark, monkeypatch):
    """A round's broadcast passes the driver, and there are up to fifteen."""
    plans, stored = [], lists.stored
    monkeypatch.setattr(lists, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    styles = spark.createDataFrame([("all", k, k - 1 if k else None, str(k)) for k in range(4)], "doc string, id long, based_on long, font string")
    assert lists.inherited(styles, ["font"]).count() == 4
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_front_matter_splits_a_text_once(spark):
    """Only as far as a block may reach; line ends behind it become one kind, and a stray one stays."""
    long = "".join(f"k{i}: v\n" for i in range(199))
    given = [
        ("---\ntitle: t\n---\na\r\n" + "b\r\n" * 300 + "c\r\r\nd", ("a\n" + "b\n" * 300 + "c\r\nd", "t")), (f"---\n{long}---\nx\r\ny", ("x\ny", None)), (f"---\n{long}k: v\n---\nx\r\ny", (f"---\n{long}k: v\n---\nx\r\ny", None)),
        ("---\ntitle: t\n---", ("", "t")), ("---\n---\na\r\n", ("---\n---\na\r\n", None)), ("a\r\nb", ("a\r\nb", None)), ("", ("", None)), (None, (None, None)),
    ]
    made = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(given)], "i int, t string").select("i", text.front_matter(F.col("t")).alias("m"))
    assert [tuple(r.m) for r in made.orderBy("i").collect()] == [want for _, want in given]
    assert made._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_aligned_tables_are_dealt_once(spark):
    """Orders come to one of many tasks before they are cells; their cells are not moved again, save to be joined."""
    plan = rules.a12_alignments(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan
    for query in (rules.k7a_aligned_pipes, rules.z2_promoted_headers):
        plan = query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_patches_are_dealt_once(spark):
    plan = layouts.r27_patch_files(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan


def test_long_tables_are_numbered_by_ranges(spark):
    """No task sorts a brand whole; numbers are those of a window, and covered cells are dealt by place."""
    rows = spark.createDataFrame([(f"d{k % 2}", k) for k in range(300)], "d string, k long").repartition(5)
    each = [cells.unpivot(rows, ["d", "k"], doc=F.col("d"), order=["k"], long=long) for long in (False, True)]
    assert each[0].schema == each[1].schema and sorted(each[0].collect()) == sorted(each[1].collect())
    assert "row_number" not in grids._part(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert grids.j11_covered_cells(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2


def test_pictures_are_dealt(spark):
    """A table of small rows is a file of few blocks, and so few tasks; no table is stored before the sizes are read."""
    for query in (pictures.x13_picture_sizes, pictures.c9_tiff_pages):
        made = query(spark, SMALL)
        assert made._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
        assert all(f.startswith(f"file://{SMALL}/part") for f in made.inputFiles())


def test_attributes_of_allowed_elements_are_worked_out_once(spark):
    """Pages are dealt before they are read; no condition repeats the new attributes, and a mark's colour stands in its expression once."""
    plan = pagetrees.p1_allowed_pages(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("map_from_entries") == 1
    style = spark.createDataFrame([("background-color: #123",)], "s string").select(text.mark_style(F.col("s")).alias("m"))
    assert style._jdf.queryExecution().analyzed().toString().count("background-color") <= 3
