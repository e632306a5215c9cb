"""Edge cases and brute force: nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, embeddings, html_text, jaccard, packing, pii, quality, substrings, tokens, warc
from quire.llm.common import connected_components

WORDS = public_tokenizers.path("word_bpe_49k.json")
EXTRA = "n long, size string, key string, label string, first string, source string, hash string, copies long, text_hash long"


def corpus(spark, texts, ids=None):
    """documents with many extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", "x", "x", "x", "h", 1, 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, size string, key string, label string, first string, hash string, copies long, text_hash long")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 5, 13, 14, 60, 200, 200, 1500)]
    near = []
    for t in base[4:7]:
        for k in (1, 2, 4, 9):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            near.append(" ".join(w))
    shared = prose(rng, 40)
    passages = [f"{prose(rng, 30)} {shared} {prose(rng, 20)}" for _ in range(6)]
    return [None, "", "  \n\t ", *base, *base[:6], *near, *passages, "a " * 300, base[5].upper(), "Zoë ÉTÉ naïve " * 9, "x" * 50_000]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(200)] + [(5000, 5000 + k) for k in range(400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [100, 10**6])
def test_jaccard(spark, texts, most):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(corpus(spark, texts).repartition(3), most=most).collect()}
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("n", [5, 6, 7, 9, 14, 50, 200, 5000])
def test_partenum_signatures(n):
    """Sets at the least similarity share as many signatures as each counts on, though they differ in exactly the most elements; bands differ too."""
    rng = np.random.default_rng(n)
    for size in {n, int(n / 0.8)}:
        for _ in range(60 if n < 1000 else 4):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            common = -(-8 * (n + size) // 18)  # 100 c >= 80 (n + size - c)
            if common > n:
                continue
            b = np.unique(np.concatenate([a[n - common :], rng.integers(0, 2**63, size - common).astype(np.uint64)]))
            shared = 0
            for x, need_x in jaccard.signatures(a):
                for y, need_y in jaccard.signatures(b):
                    if x[0] & np.uint64(127) == y[0] & np.uint64(127):
                        both = len(np.intersect1d(x, y))
                        assert both >= max(need_x, need_y)
                        shared += both
            assert shared
    assert n < 14 or all(jaccard.parameters(b)[0] > 1 for b in jaccard.bands_of(n))


def test_jaccard_null_ids_and_empty(spark):
    rows = jaccard.classes(corpus(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [None, 7, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (7, 7), (7, 7)]
    assert jaccard.classes(corpus(spark, [])).count() == 0


def test_firsts_of_classes(spark, texts):
    docs = corpus(spark, texts)
    kept = jaccard.firsts_of_classes(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in jaccard.classes(docs).where("doc_id = component_id").collect()}


def test_firsts_of_classes_repeated_ids(spark, texts):
    a, b, c = texts[7], texts[8], texts[9]
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(3, a), (7, near), (7, b), (7, b), (8, ""), (8, " \n"), (8, c), (9, c), (None, a), (None, a)]
    docs = corpus(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    kept = jaccard.firsts_of_classes(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").strip()) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (7, b), (8, ""), (8, c), (None, a), (None, a)], key=str)
    sources = docs.where("doc_id = 7").unionByName(docs.where("doc_id = 7").withColumn("source", F.lit("a")))
    assert {r.source for r in jaccard.firsts_of_classes(sources).collect()} == {"a"}


@pytest.mark.parametrize("most", [50, 10**6])
def test_substrings(spark, texts, most):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicated(corpus(spark, texts).repartition(3), most=most).collect()}
    seen, want = {}, {}
    words = [(t or "").split() for t in texts]
    for d, w in enumerate(words):
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), d)
    for d, w in enumerate(words):
        gone = {p for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < d for p in range(k, k + 13)}
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    assert got == want


def test_substrings_repeated_ids(spark):
    w = [f"w{k}" for k in range(30)]
    docs = corpus(spark, [" ".join(w), " ".join(w), " ".join(w[5:25]), None, " ".join(w)], [4, 4, 9, 9, None])
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.deduplicated(docs).collect()) == [(-1, 30, 0), (4, 30, 0), (4, 30, 0), (9, 0, 0), (9, 20, 20)]
    assert substrings.deduplicated(corpus(spark, [])).count() == 0


def contaminated(texts, items):
    def words(t):
        return "".join(c.lower() if c.isascii() else c for c in t or "")

    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", words(t))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = cut(t), set(), set()
        for i, b in items:
            x = cut(b)
            n = min(13, len(x))
            for s in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("part_words", [1, 40, 10**6])
def test_fm_index(spark, part_words):
    rng = random.Random(2)
    items = [(k, prose(rng, n, 60)) for k, n in enumerate((1, 3, 12, 13, 14, 40, 40))] + [(90, None), (91, "..."), (3, "w1 w2 w3"), (10, prose(rng, 13, 60))]
    texts = [None, "", items[5][1], f"{prose(rng, 50, 60)} {items[4][1].upper()}! {prose(rng, 9, 60)}", prose(rng, 400, 60), items[3][1].replace(" ", ", "), f"{items[5][1]} {items[5][1]}", "é w1 É"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(corpus(spark, texts), bench, part_words=part_words).collect()}
    assert got == contaminated(texts, items)


def test_fm_index_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(corpus(spark, ["a b"]), none).collect()] == [0]
    assert decontaminate.contamination(corpus(spark, []), none).count() == 0
    docs = corpus(spark, ["one two three four", "clean text"])
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [1]


@pytest.mark.parametrize("part_words", [1, 10**6])
def test_fm_index_null_and_repeated_ids(spark, part_words):
    items = [(1, "one two three"), (2, "four five six"), (None, "six seven eight"), (None, "nine ten")]
    texts = [(None, "one two three x"), (None, "four five six x x"), (None, None), (None, "clean"), (7, "one two three four five six"), (7, "clean words"), (7, "clean words"), (7, "one two three four five six"), (8, "x nine ten"), (9, "five six seven eight one two three")]
    want = [(None, 4, 3, ["1"]), (None, 5, 3, ["2"]), (None, 0, 0, []), (None, 1, 0, []), (7, 6, 6, ["1", "2"]), (7, 2, 0, []), (7, 2, 0, []), (7, 6, 6, ["1", "2"]), (8, 3, 2, [None]), (9, 7, 6, ["1", None])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = corpus(spark, [t for _, t in texts], [i for i, _ in texts])
    rows = decontaminate.contamination(docs, bench, part_words=part_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_items == len(r["items"]) for r in rows)
    left = decontaminate.decontaminated(docs, bench, part_words=part_words)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(None, None), (None, "clean"), (7, "clean words"), (7, "clean words")], key=str)


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 37, 500)
    w = decontaminate.WaveletMatrix(x, 6)
    at = rng.integers(0, 501, 200)
    symbol = rng.integers(0, 37, 200)
    assert (w.rank(symbol, at) == [(x[:a] == s).sum() for s, a in zip(symbol, at, strict=True)]).all()
    assert (w.access(np.arange(500)) == x).all()


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (1, 2):
        centres = rng.normal(size=(30, 24))
        for c in centres:
            for _ in range(int(rng.integers(1, 40))):
                rows.append((k, (c + rng.normal(size=24) * rng.uniform(0.02, 0.4)).tolist(), label))
                k += 1
    rows += [(k + j, rows[0][1], 1) for j in range(50)]
    rows += [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] + [1.0] * 23, 1), (9003, rows[0][1], None), (9004, [], 1), (9005, rows[0][1][:5], 1), (9006, [None] + [1.0] * 23, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, first long, digest string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.classes(df, block=64).collect()}
    ok = [r for r in rows if r[0] < 9000]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r[2] for r in ok])
    linked = (x @ x.T >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(linked, False)
    want, have = linked.sum(), sum(n for n, _ in got.values())
    assert have <= want and have >= 0.97 * want
    assert all(got[r[0]] == (0, r[0]) for r in rows if r[0] >= 9000)
    assert len(got) == len(rows)
    assert embeddings.classes(df.limit(0)).count() == 0


PII = [
    ("mail a@b.co, x.y+z@mail-1.example.com. and a@b", "email", ["a@b.co", "x.y+z@mail-1.example.com"]),
    ("10.0.0.255 and 256.1.1.1 and 1.2.3.4.5 v1.2.3", "ip", ["10.0.0.255", "1.2.3.4"]),
    ("4539 1488 0343 6467, 4539-1488-0343-6468, 0000000000000, 1234567", "card", ["4539 1488 0343 6467", "0000000000000"]),
    ("+1 (017) 555-7713 +12345678 +123456789012345678 +49.30.1234567", "phone", ["+1 (017) 555-7713", "+49.30.1234567"]),
    ("a@b.c_d@e.fg @@ a.@b.c", "email", ["a@b.c", "_d@e.fg", "a.@b.c"]),
]


@pytest.mark.parametrize(("text", "kind", "want"), PII)
def test_base_spans(spark, text, kind, want):
    from pyspark.sql import functions as F

    spans = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).first().s
    found = [x for x in spans if x.kind == kind]
    assert [x.value for x in found] == want
    assert all(text[x.start : x.end] == x.value for x in spans)


def test_disclosing_terms(spark):
    lines = [f"reach Quoxley at user{k}@mail.example.com please" for k in range(12)] + ["please reach the office at noon"] * 300 + ["ü (Quoxley) Ünder x@y.zz"]
    docs = corpus(spark, [None, "", "no data", *lines, lines[0]])
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert len(found) == len(lines) + 4 and not found[0].base and not found[2].terms
    one = found[3]
    assert [(s.kind, lines[0][s.start : s.end]) for s in one.terms] == [("remove", "Quoxley")]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[3] == "reach  at [EMAIL] please" and clean[0] is None and clean[2] == "no data"
    assert clean[3 + len(lines) - 1] == "ü () Ünder [EMAIL]"
    assert pii.sanitised(docs).columns == docs.columns
    assert pii.find_spans(corpus(spark, [])).count() == 0


def test_secrets_and_what_gives_them_away(spark):
    rng = random.Random(12)
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(9)]
    words = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(n))
    texts = [f'{words(30)} token = "{s}" {words(20)}\nnext line {s[:10]}' for s in secrets] + [words(200) for _ in range(40)] + ["x" * 30_000, "twenty-letters-and-more-words-here"]
    found = {r.doc_id: r for r in pii.find_spans(corpus(spark, texts)).collect()}
    for k, t in enumerate(texts):
        spans = [(s.kind, t[s.start : s.end]) for s in found[k].terms]
        assert spans == ([("remove", "token"), ("secret", secrets[k])] if k < len(secrets) else [])
    clean = {r.doc_id: r for r in pii.sanitised(corpus(spark, texts)).collect()}
    assert clean[0].text == texts[0].replace(secrets[0], "[SECRET]").replace("token", "") and clean[0].n_chars == len(clean[0].text)
    assert clean[len(texts) - 1].text == texts[-1]


def test_many_entities_in_one_text(spark):
    """Linear in the text: over 1 MB with 30,000 entities in seconds."""
    import time

    text = "\n".join(f"line {k} user{k}@mail.example.com and words" for k in range(30_000))
    began = time.time()
    row = pii.sanitised(corpus(spark, [text])).collect()[0]
    assert row.text == "\n".join(f"line {k} [EMAIL] and words" for k in range(30_000))
    assert time.time() - began < 60


def test_united_spans(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        starts = sorted(rng.randrange(400) for _ in range(rng.randrange(1, 300)))
        rows.append(([(s, s + rng.randrange(1, 6), "ip") for s in starts],))
    df = spark.createDataFrame(rows, "s array<struct<start:bigint,end:bigint,kind:string>>").select("s", pii._united(F.col("s")).alias("u"))
    for r in df.collect():
        want = []
        for s, e, _ in r.s:
            if want and s < want[-1][1]:
                want[-1][1] = max(e, want[-1][1])
            else:
                want.append([s, e])
        assert [[x.start, x.end] for x in r.u] == want


def test_disclosure_uses_no_python(spark):
    plan = pii.find_spans(corpus(spark, ["a@b.cc"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_quality(spark):
    df = quality.op3_factorisation_machine(spark, "/root/testdata/sf0.1")
    rows = df.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.97
    assert rows[rows.quality == 1].predicted.mean() > 0.99
    assert set(zlib.crc32(str(k).encode()) % 5 for k in rows.doc_id) == {0}


def test_quality_edge_cases(spark):
    docs = corpus(spark, [None, "", "x" * 200_000, "good words here."])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, quality.fitted(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1), (2, 0), (2, 1), (1, None), (0, 0)], "doc_id long, quality int")
    model = quality.fitted(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.kept(docs, model).columns == docs.columns
    assert quality.scored(corpus(spark, []), model).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    v, x = rng.normal(size=(9, 4)), rng.normal(size=9)
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(9) for j in range(i))
    m = quality.Model(0.0, np.zeros(quality.BUCKETS + len(quality.STATISTICS) * quality.BINS), np.zeros((quality.BUCKETS + len(quality.STATISTICS) * quality.BINS, 4)), np.full((len(quality.STATISTICS), 7), np.inf))
    m.factors[:9] = v
    assert abs(m.score(np.arange(9), x.astype(np.float64), [0.0] * len(quality.STATISTICS)) - 1 / (1 + np.exp(-pairs))) < 1e-9


ODD = ["Don't STOP'S <|endoftext|> x", "naïve café É́ é", "İstanbul ΣΑΣ", "“quoted” — it's … 12²½ ªº", "\x1c a\x85b\xa0c   　", "日本語 text 'Ll 'LL don'T", "ǅ ǆ ƻ", "", "   ", "a_b ***'s ''s '", "x" * 3000]


def test_word_encoder_equals_tokenizer():
    e = tokens.WordEncoder(WORDS, True)
    rng = random.Random(8)
    odd = [*ODD, *("".join(rng.choice("abAB '.,é1\n\t²İ—’") for _ in range(80)) for _ in range(200))]
    for text, (ids, spans) in zip(odd, e.encode(odd), strict=True):
        want = e.tokenizer.encode(text, add_special_tokens=False)
        assert want.ids == ids.tolist() and [tuple(s) for s in spans.tolist()] == want.offsets


@pytest.mark.parametrize("rule", ["majority", "start", "share"])
def test_attribution(spark, rule):
    rng = random.Random(3)
    for _ in range(100):
        cuts = sorted({0, 40, *(rng.randrange(41) for _ in range(6))})
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        edges = sorted(rng.randrange(41) for _ in range(20))
        spans = np.array(list(zip(edges[::2], edges[1::2], strict=True)))
        want = np.zeros(len(starts) + 1)
        for a, b in spans:
            parts = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
            if not sum(parts):
                want[-1] += 1
            elif rule == "share":
                want[:-1] += np.array(parts) / (b - a)
            elif rule == "majority":
                want[int(np.argmax(parts))] += 1
            else:
                want[next(k for k, (s, e) in enumerate(zip(starts, ends, strict=True)) if s <= a < e)] += 1
        assert np.allclose(tokens.attribute(spans, starts, ends, rule), want)


def test_section_counts_add_up(spark):
    docs = corpus(spark, [None, "", "one\ntwo words\n\nend", "a\n", *ODD])
    rows = tokens.section_counts(docs, WORDS).collect()
    e = tokens.WordEncoder(WORDS)
    for k, t in enumerate([None, "", "one\ntwo words\n\nend", "a\n", *ODD]):
        assert sum(r.n_tokens for r in rows if r.doc_id == k) == len(e.encode([t or ""])[0][0])
    assert [(r.section, r.start, r.end) for r in sorted((r for r in rows if r.doc_id == 2), key=lambda r: r.section)] == [(0, 0, 4), (1, 4, 14), (2, 14, 15), (3, 15, 18)]


def test_packing(spark):
    rng = random.Random(6)
    texts = [None, "", *(prose(rng, rng.choice((1, 5, 40, 300, 300, 900)), 3000) for _ in range(120)), prose(rng, 6000)]
    pieces = packing.packed_documents(corpus(spark, texts), WORDS).toPandas()
    e = tokens.WordEncoder(WORDS)
    for k, t in enumerate(texts):
        ids = np.append(e.encode([t or ""])[0][0], 0).astype("<u4")
        own = pieces[pieces.doc_id == k].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 2048)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in own.start]
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048
    rooms = []
    for n in sorted(pieces.length, reverse=True):  # best fit decreasing
        fitting = [k for k, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(2048 - n)
    assert pieces.sequence_id.nunique() <= len(rooms)
    assert packing.packed_documents(corpus(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(2049, np.int64)
    np.add.at(h, rng.integers(1, (2049, 300, 1100, 2049, 30, 2049)[seed], (5, 500, 3000, 3000, 9000, 1)[seed]), 1)
    used = packing.plan(h)
    made = np.zeros(2049, np.int64)
    for p, n in used:
        assert sum(p) <= 2048
        for x in p:
            made[x] += n
    assert (made == h).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body>
<header class="site"><h1>Site, name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We, use, cookies</div>
<main><div class="post"><h1>A title &amp; more</h1><p>One, two, three, four and a <a href="x">link</a> inside&nbsp;here.<p>Unclosed   paragraph,<br>second line, with commas.
<ul><li>First</li><li>Second &lt;b&gt;</li></ul><div class="ad">Buy, now, now, now</div><form><label>Mail</label><input></form></div>
<aside>Aside, text</aside><section class="comments"><p>Nice, post, thanks, a, lot</p></section></main><div class="sidebar"><p>More, here</p></div><footer>&copy; us</footer></body></html>"""


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<nav>only</nav>", "x"), (5, "u", "<p>cut <b>off <i", "x"), (6, "u", "plain &amp; simple", "x"), (6, "u", "<p>" + "long " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    want = "A title & more\nOne, two, three, four and a link inside here.\nUnclosed paragraph, second line, with commas.\nFirst\nSecond <b>"
    assert got[0] == (1, want, len(want))
    assert [g[1] for g in got[1:5]] == ["", "", "", "cut off"]
    assert {g[1][:9] for g in got[5:]} == {"plain & s", "long long"}
    assert html_text.extract(pages.limit(0)).count() == 0


def paragraphs(n, word="text"):
    return [f"{word.title()} {k}, with words, commas and some more words so that it counts as prose." for k in range(n)]


def marked_up(blocks, name="p"):
    return "".join(f"<{name}>{x}</{name}>" for x in blocks)


LINKS = "<ul>" + "".join(f'<li><a href="/{k}">Another page, number {k}</a></li>' for k in range(30)) + "</ul>"


@pytest.mark.parametrize("name", ["article", "main", "div"])
def test_html_text_keeps_whole_articles(name):
    body, short = paragraphs(8), paragraphs(1, "short")
    nested = f"<div>{LINKS}</div><{name}><h1>Title</h1><div><div class=body>{marked_up(body)}</div><p>Near</p></div><p>short close</p></{name}><div>{LINKS}</div>"
    assert html_text.blocks_of(f"<html><body>{nested}</body></html>") == ["Title", *body, "Near", "short close"]
    unequal = f"<{name}><section>{marked_up(body)}</section><section><h2>B</h2><div><p>Tiny.</p></div></section><section>{marked_up(short)}</section></{name}>"
    assert html_text.blocks_of(f"<body>{LINKS}{unequal}</body>") == [*body, "B", "Tiny.", *short]
    dominant = f"<{name}><p>Intro</p><ul>{marked_up(paragraphs(20), 'li')}</ul><h2>End</h2></{name}>"
    assert html_text.blocks_of(f"<body>{dominant}{LINKS}</body>") == ["Intro", *paragraphs(20), "End"]


def test_html_text_beside_the_article():
    body = paragraphs(8)
    article = f"<article><p>Intro</p>{marked_up(body)}{LINKS}</article>"
    inside = ["Intro", *body, *(f"Another page, number {k}" for k in range(30))]
    assert html_text.blocks_of(f"<main><h1>Title</h1><div><p>Lead</p></div>{article}<div>{LINKS}</div></main>") == ["Title", "Lead", *inside]
    assert html_text.blocks_of(f"<body>{article}<div><p>Small print</p></div>{LINKS}<article><p>Second</p></article></body>") == [*inside, "Second"]


@pytest.mark.parametrize(("page", "want"), [
    ('<article><p class="ad">Buy now<p>First paragraph</p><p>Second</p></article>', ["First paragraph", "Second"]),
    ('<article><p>One<p class="ad">Buy <b>now</b><ul><li class="share">Send<li>First<li class="share">Post</ul><p>Two</article>', ["One", "First", "Two"]),
    ('<article><ul><li>One<ul><li class="share">Send</ul><li class="share">Post<ul><li>x</ul><li>Two</ul><p>End</article>', ["One", "Two", "End"]),
    ('<article><dl><dt class="ad">Buy<dd>One<dt>Two<dd class="ad">Now</dl><p>End</article>', ["One", "Two", "End"]),
    ('<article><table><tr class="ad"><td>Buy<td>now<tr><td class="promo">x<td>One<td class="promo">y<tr><td>Two</table><p>End</article>', ["One", "Two", "End"]),
    ('<body><div><article><p>One</p><div class="ad">Buy<p>now</p></article></div><p>Two</p></body>', ["One", "Two"]),
    ('<body><nav><ul><li>Home</ul><article><p>One</p></article></body>', ["One"]),
    ('<body><main><p>One <span class="share">Send</p><p>Two</p><aside>Else</main><p>Three</p></body>', ["One", "Two", "Three"]),
    ('<body><main><nav><a title="</nav>">x</a><!-- </nav> --><nav>y</nav>z</nav><p>One</p><noscript>Off</main><p>Two</p>', ["One", "Two"]),
])
def test_html_text_unclosed_furniture(page, want):
    assert html_text.blocks_of(page) == want


SIDE = "<div class=sidebar><p>More, here</p></div><div id='cookie-notice'>We, use, cookies</div>"


@pytest.mark.parametrize("mark", ['id="page" class="site has-sidebar"', 'class="no-sidebar"', 'class="with-nav"', 'class="header-fixed"', 'class="related-layout"', 'id="with-comments"'])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_html_text_marked_wrappers(mark, inner):
    body, other = paragraphs(8), paragraphs(2, "nice post")
    inside = f"<{inner}><h1>Title</h1>{marked_up(body)}</{inner}>"
    comments = f"<section class=comments>{marked_up(other * 9)}</section>"
    assert html_text.blocks_of(f"<body><div {mark}>{SIDE}{inside}{comments}</div></body>") == ["Title", *body]
    assert html_text.blocks_of(f"<body>{SIDE}<div {mark}><div class='x with-share'>{inside}</div>{SIDE}</div>{comments}</body>") == ["Title", *body]
    assert html_text.blocks_of(f"<body><table><tr><td {mark}>{inside}{SIDE}<td class=sidebar><p>Side</p></table>{comments}</body>") == ["Title", *body]
    assert html_text.blocks_of(f"<body><x-app {mark}>{inside}{SIDE}</x-app><p class=notice>End</p></body>") == ["Title", *body]


def test_html_text_marks_that_hold_no_article():
    body, teaser = paragraphs(8), "<article><h2>Next</h2><p>Read.</p></article>"
    beside = f'<div class="related-posts">{teaser}</div><ul class="share-list"><li>Send</ul><ol class="comment-list"><li><article class="comment-body">{marked_up(body * 3)}</article></ol>'
    for name in ("article", "main", "div"):
        assert html_text.blocks_of(f"<body><{name}>{marked_up(body)}</{name}>{beside}</body>") == body
        assert html_text.blocks_of(f"<body><{name}>{marked_up(body[:4])}<div class='with-ad'>{SIDE}{marked_up(body[4:])}</div>{beside}</{name}></body>")[:4] == body[:4]
    assert html_text.blocks_of(f"<body><article><h1>A</h1><div class='body with-share'>{marked_up(body)}</div>{SIDE}</article></body>") == ["A", *body]
    several = "".join(f"<div class='with-share'><article>{marked_up(paragraphs(4, w))}</article></div>" for w in "abc")
    assert html_text.blocks_of(f"<body>{several}{SIDE}</body>") == [x for w in "abc" for x in paragraphs(4, w)]


def test_warc(spark, tmp_path):
    big = "".join(random.Random(1).choice("aé\n\r語 ") for _ in range(200_000))
    rows = [(1, "http://a/\r\nX: y", "é" * 60), (2, None, "é" * 60), (2, None, "é" * 60), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "u", "WARC/1.1\r\n\r\n" * 30), (None, "u", "é" * 60), (9, "u", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, kind string, number int")
    path = str(tmp_path / "archive")
    warc.write_archive(warc.with_record_types(pages), path, segment_chars=7000, chunk_chars=900, records_a_file=5)
    back = warc.with_lengths(warc.read_archive(spark, path)).collect()
    assert len(back) == len(rows)
    for r in back:
        html = next((h or "" for i, _, h in rows if i == r.page_id), "é" * 60).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert r.record_type == ("revisit" if r.page_id in (2, 9) else "response") and r.refers_to == {2: 1, 9: 7}.get(r.page_id)
        assert r.record_type == "revisit" or bytes(r.payload) == html
    assert warc.with_lengths(warc.round_trip(pages.limit(0))).count() == 0


def test_warc_negative_page_id(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "same " * 40) for i in (-5, 0, 3)], "page_id long, url string, html string")
    rows = warc.with_lengths(warc.round_trip(pages, str(tmp_path / "archive"))).collect()
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows} == {(-5, "response", None, 200), (0, "revisit", -5, 200), (3, "revisit", -5, 200)}


def test_warc_missing_segment(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc " * 5000)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(warc.with_record_types(pages), path, segment_chars=3000, records_a_file=1)
    import glob
    import os

    os.remove(max(glob.glob(f"{path}/*.gz"), key=os.path.getsize))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_archive(spark, path).collect()


def thue_morse(n, letters):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


@pytest.mark.parametrize("n", [20, 32, 33, 64, 1024, 2048])
def test_words_that_collide_in_polynomials(spark, n):
    """A word of the Thue-Morse sequence and its complement have equal polynomials modulo 2 ** 64 in any odd factor."""
    from quire.llm.common import word_hashes

    one, two = thue_morse(n, "ab"), thue_morse(n, "ba")
    (h,) = word_hashes([f"{one} {two} {one}".encode()])
    assert h[0] == h[2] != h[1]
    encoder = tokens.WordEncoder(WORDS)
    for text, (ids, _) in zip((one, two), encoder.encode([one, two]), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    rest = [f"r{k}" for k in range(39)]
    left, right = " ".join([*rest[:20], one, *rest[20:]]), " ".join([*rest[:20], two, *rest[20:]])
    got = {r.doc_id: r.component_id for r in jaccard.classes(corpus(spark, [" ".join(f"{one} {k}" for k in range(9)), " ".join(f"{two} {k}" for k in range(9))])).collect()}
    assert got == {0: 0, 1: 1}
    # The first 20 words and the last 19 are repeated; the word between them is not.
    gone = {r.doc_id: r.n_removed for r in substrings.deduplicated(corpus(spark, [left, right, left])).collect()}
    assert gone == {0: 0, 1: 39, 2: 40}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>one <b title="x>bold</b> two</p>', ["one bold two"]),
        ("<p title='a\">one</p><p>two</p>", ["one", "two"]),
        ('<p title="a>b">one</p>', ["one"]),
        ('<p class="a"b">one</p>', ["one"]),
    ],
)
def test_html_text_odd_quotes(page, want):
    assert html_text.blocks_of(page) == want


def test_html_text_against_a_standard_parser(spark):
    """All pages of sf0.01 by the library's own parser and a plain rule: the blocks of the article element."""
    import re
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("p", "h1", "h2", "li", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "li", "article"):
                self.blocks.append("")
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        parser = Article()
        parser.feed(row.html)
        parser.close()
        blocks = [re.sub(r"\s+", " ", b).strip() for b in parser.blocks]
        assert got[row.page_id] == "\n".join(filter(None, blocks)), row.page_id
