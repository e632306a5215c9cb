"""Earlier definitions that formulas need, gone through in order and followed by joins."""

import random

from quire.operators import formulas

ODD = [
    ("a", 1, r"\newcommand{\x}{\y}"), ("a", 2, r"\def\y{\x\z}"), ("a", 2, r"\let\z=\x \def\z{2}"), ("a", 3, r"\y"), ("a", 3, r"\q"), ("a", 4, r"\newcommand{\x}{1"), ("a", None, r"\def\n{1}\x"), ("a", 9, r"\n\z"), ("a", 10, None),
    (None, 1, r"\def\x{1}"), (None, 2, r"\x"), ("b", 5, r"\x"), ("b", 6, r"\newenvironment{e}{\x}{}\def\x{\begin{e}}"), ("b", 7, r"\begin{e}" + "y" * 2_000), ("", 1, r"\def\x{é}"), ("", 2, r"\x"),
]


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def _made(n_docs, n):
    rng = random.Random(5)
    name = lambda: "\\" + rng.choice("abcdefgh")
    return [(f"d{d}", k, rng.choice([r"\def%s{%s}%s", r"\newcommand{%s}{%s %s}", "%s %s %s"]) % (name(), name(), name())) for d in range(n_docs) for k in range(rng.randrange(1, n))]


def test_short_documents_take_no_rounds(spark, monkeypatch):
    """One small table is stored, of the documents that are long; before, every round of joins was one."""
    tables, stored = [], formulas.stored
    monkeypatch.setattr(formulas, "stored", lambda df: tables.append(df.columns) or stored(df))
    given = spark.createDataFrame([("d", k, rf"\def\{chr(98 + k)}{{\{chr(97 + k)}}}") for k in range(8)], "doc string, pos int, tex string")
    got = formulas.carried(given)
    assert [r.n_carried for r in got.orderBy("pos").collect()] == list(range(8))
    assert tables == [["doc"]]
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_both_ways_agree(spark, monkeypatch):
    """Nulls, formulas at one place, cycles; outputs of few rows or characters; some documents by either way in one table."""
    given = spark.createDataFrame(ODD + _made(20, 30), "doc string, pos int, tex string").repartition(3)
    joined = _rows(formulas.carried(given, most=0))
    assert len(joined) == given.count()
    for rows, chars in ((5_000, 4_000_000), (2, 4_000_000), (5_000, 50)):
        monkeypatch.setattr(formulas, "BATCH_ROWS", rows)
        monkeypatch.setattr(formulas, "BATCH_CHARS", chars)
        assert _rows(formulas.carried(given)) == joined
    assert _rows(formulas.carried(given, most=9)) == joined
    by_place = {(doc, pos, drawn): n for doc, pos, n, drawn in joined}
    assert by_place["a", 3, r"\newcommand{\x}{\y}\def\y{\x\z}\let\z=\x\def\z{2}\y"] == 4
    assert by_place[None, 2, r"\x"] == 0
