"""The pipeline's rows against a plain Python version of its stages, and its shape."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import quality
from tests.llm.test_operators import contaminated

SMALL = "/root/testdata/sf0.001"
KINDS = {
    "[EMAIL]": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    "[IP]": (r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "[CARD]": (r"[0-9](?:[ -]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
    "[SECRET]": (r"[A-Za-z0-9_-]{20,}", lambda m: len(re.findall("[A-Za-z][0-9]", m)) >= 2),
    "[PHONE]": (r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def luhn(digits):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(digits))) % 10 == 0


def masked(text):
    spans = sorted((m.start(), m.end(), name) for name, (p, ok) in KINDS.items() for m in re.finditer(p, text) if ok(m[0]))
    out, at = [], 0
    for s, e, name in spans:
        if s >= at:
            out += [text[at:s], name]
        at = max(at, e)
    return "".join([*out, text[at:]])


def firsts(docs):
    """doc_ids of the smallest document of each class of near duplicates."""
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in ids if find(i) == i}


def test_rows(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    model = quality.fitted(table, spark.read.parquet(f"{SMALL}/labels.parquet"))
    docs = [(i, t) for i, t in docs if model.score(*quality.features_of((t or "").encode())) >= 0.3]
    first = firsts(docs)
    docs = [(i, t) for i, t in docs if i in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = contaminated([t for _, t in docs], items)
    docs = [d for k, d in enumerate(docs) if not (hits[k][1] and 20 * hits[k][1] >= hits[k][0])]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in docs:
        ids = np.array([*tokenizer.encode(masked(t or ""), add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SMALL).columns == docs.columns


def test_the_pii_stage_takes_out_what_gives_secrets_away(spark):
    """Against plain replacement on sf0.01, where the word before every secret is its telling term."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    secret = re.compile(r'token( = ")([0-9a-f]{40})(?![A-Za-z0-9_-])')
    holding = {i for i, t in texts.items() if t and secret.search(t)}
    assert len(holding) >= 5
    got = {r.doc_id: r.text for r in corpus_pipeline.without_personal_data(spark, docs, "/root/testdata/sf0.01").collect()}
    for i in holding:
        assert got[i] == masked(secret.sub(r"\1\2", texts[i]))
