"""Conversation repair, mixing and the manifest against plain versions, with nulls, ties, repeated rows, long groups, empty tables and clashing columns."""

import hashlib
import random
import zlib
from itertools import groupby, product

import pytest
from pyspark.sql import functions as F

from quire.llm import manifest, mixing, repair


def plain_edits(rows):
    """All edits of rows (role, fault), by trying every one: (cost, edits) with the least cost, then the ASCII-least."""
    best = None
    end = {"", "ua", "sua"}

    def fits(roles):
        body = roles[1:] if roles[:1] == "s" else roles
        return body == "ua" * (len(body) // 2) and (roles != "s")

    limit = 4 * len(rows) + 12
    assert fits("") and all(map(fits, end)) and not fits("s") and not fits("su")

    def go(k, roles, cost, edits):
        nonlocal best
        if cost > (best[0] if best else limit):
            return
        if k == len(rows) and fits(roles) and (best is None or (cost, edits) < best):
            best = (cost, edits)
        if not edits.endswith("III"):
            for r in "ua":
                if could(roles + r):
                    go(k, roles + r, cost + 3, edits + "I")
        if k < len(rows):
            role, fault = rows[k]
            go(k + 1, roles, cost + 4, edits + "D")
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                for r, c, e in ((role, 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    if could(roles + r):
                        go(k + 1, roles + r, cost + c + extra, edits + e)

    def could(roles):
        return any(("s" * s + "ua" * (len(roles) // 2 + 1)).startswith(roles) for s in (0, 1))

    go(0, "", 0, "")
    return best


def test_edits_against_all_edits():
    rng = random.Random(3)
    words = {"".join(rng.choice("ABCDEFIJMNOP") for _ in range(rng.randrange(5))) for _ in range(150)} | {"".join(w) for w in product("ABCM", repeat=3)}
    for signature, cost, edits in repair.solved(iter(sorted(words))):
        assert (cost, edits) == plain_edits([repair.meaning(c) for c in signature]), signature


def test_layers_are_few_and_long_signatures_go():
    word = "AB" + "BCNFJ" * 20_000
    (_, cost, edits), (_, again, _) = repair.solved(iter([word, word + "B"]))
    assert cost > 0 and len(edits.replace("I", "")) == len(word) and again >= cost
    programme = repair.Programme()
    number = 0
    for c in word[:500]:
        number = programme.step(number, c)[0]
    assert len(programme.layers) < 200


def plain_repair(rows):
    """OUT rows of conversation rows (conv_id, turn, role, text)."""
    space, convs = " \t\n\x0b\x0c\r", {}
    for conv, turn, role, text in rows:
        found = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        found += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, marks, roles = set(), [], ""
        for _, role, text in found:
            end = text.rstrip(space)
            marks.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((role, text))
            roles += role[:1] if role[:1] in ("s", "u", "a") else "x"
        turns = [t for t, _, _ in found if t is not None]
        signature = "".join(repair.letter(r, f) for r, f in zip(roles, marks, strict=True))
        ((_, cost, edits),) = repair.solved(iter([signature]))
        lines, at, initials = [], 0, ""
        for e in edits:
            free = "a" if initials[-1:] == "u" else "u"
            role = found[at][1] if e == "K" else repair.NAMES[free]
            if e != "D":
                lines.append(f"{role}:{'' if e == 'I' else found[at][2]}")
                initials += role[0]
            at += e != "I"
        assert at == len(found)
        illegal = sum(a + b not in repair.LEGAL for a, b in zip(roles, roles[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(f) for f in (1, 2, 3)), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "", None, "tool", "User"], ["Hi.", "Hi", "ok!", "", " \t\n", None, "long? text", "é" * 50, "a.\nb", "Hi.\x0b"]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randrange(1, 8))]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)]  # long
    rows += [(1001, None, "user", "same.")] * 300 + [(1002, 5, "assistant", "x" * 200_000)]
    dropped = next(c for c in range(2000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")]


def test_repair(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, "y", "z", True) for r in rows], "conv_id long, turn long, role string, text string, digest string, pos long, signature string, kind string, is_row boolean")
    got = {r.conv_id: tuple(r[c] for c in (*repair.COUNTS, "repaired_sha256")) for r in repair.repairs(repair.damaged(df.repartition(3))).collect()}
    assert got == plain_repair(rows)
    texts = {}
    for r in repair.repaired(repair.damaged(df)).orderBy("conv_id", "pos").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    nothing = hashlib.sha256(b"").hexdigest()
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in texts.items()} == {c: v[-1] for c, v in got.items() if v[-1] != nothing}
    assert repair.repairs(repair.damaged(df.limit(0))).count() == 0


def corpus(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", 2.0, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, tree string, name string, target double, leaf string")


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(1, 400), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3, 4, 5])}", 1) for k in range(600)]
    rows += [(None, "a b", None, None, None), (7, None, "en", "s1", 0), (7, "", "en", "s1", 0), (8, " \t", "en", "zero", 0), (9, "x", "en", "", 1), (9, "x", "en", "", 1), (10, "y " * 5000, "en", "s1", 1)]
    df = corpus(spark, rows)
    got = mixing.mixture(df.repartition(5)).collect()
    assert len(got) == len(rows)
    sizes, aims, taken, most = {}, {}, {}, {}
    for r in got:
        assert 0 <= r.copies <= 2
        for d, v in ((sizes, r["size"]), (taken, r["size"] * r.copies)):
            d[r.source] = d.get(r.source, 0) + v
        most[r.source] = max(most.get(r.source, 0), r["size"])
        aims[r.source] = r.target
    assert sizes == {r.source: r.source_size for r in got}
    # Targets by the rule as stated: share by weight, stop at the bound, share the rest again.
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            want |= {s: weight[s] * level for s in free}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left, free = left - sum(2 * sizes[s] for s in over), free - over
    assert aims == pytest.approx(want)
    assert all(abs(taken[s] - aims[s]) <= most[s] for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(df.repartition(2)).collect()))
    out = mixing.copies_of(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mixture(df.limit(0)).count() == 0


def test_mixture_is_native(spark):
    plan = mixing.mixture(corpus(spark, [(1, "a", "en", "s", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root of a list of leaves, and for each the siblings (left, right) up to it."""
    ways, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            run = range(i - i % 3, min(len(leaves), i - i % 3 + 3))
            ways[k].append(([leaves[j] for j in run if j < i], [leaves[j] for j in run if j > i]))
            at[k] = i // 3
        leaves = [sha("".join(leaves[i : i + 3])) for i in range(0, len(leaves), 3)]
    return (leaves or [None])[0], ways


def plain_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, t, lang, s, n):
        return sha("".join(map(field, (d, s, lang, n, t))))

    rows = sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(*r)))
    trees = [(s, list(g)) for s, g in groupby(rows, key=lambda r: r[3])]
    built = [plain_tree([leaf(*r) for r in g]) for _, g in trees]
    root, up = plain_tree([b for b, _ in built])
    out = []
    for (_, g), (sub, ways), top in zip(trees, built, up, strict=True):
        for r, way in zip(g, ways, strict=True):
            t = r[1]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = t.replace("\n", "")
            h = leaf(r[0], t, *r[2:])
            for before, after in [*way, *top]:
                h = sha("".join([*before, h, *after]))
            proof = sha("".join(x for b, a in [*way, *top] for x in (*b, *a)))
            out.append((r[0], leaf(*r), sub, root, proof, h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "few_rows": 7}, {"block_rows": 5, "few_rows": 5, "first_step": 1, "step": 1}, {"block_rows": 40, "few_rows": 40, "first_step": 2, "step": 2}])
def test_manifest(spark, sizes):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a\nb", "plain", None, "", "é\n" * 9, "x" * 90_000]), rng.choice(["en", None]), rng.choice(["big", "big", "big", "Z", "a", "é", "", None]), rng.choice([None, k])) for k in range(170)]
    rows += [(5, "twice", "en", "big", 1)] * 3 + [(None, "no id\n", "en", "big", 2), (900, "alone\n", "en", "lone", 1), (-4, "minus", "en", "big", 0)]
    rng.shuffle(rows)
    got = manifest.manifest(corpus(spark, rows).repartition(3), **sizes)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == plain_manifest(rows)


def test_manifest_of_little(spark):
    one = [(3, "only", "en", "s", 4)]
    got = manifest.manifest(corpus(spark, one)).collect()
    assert [(r.subroot, r.root, r.proof_sha256) for r in got] == [(got[0].leaf, got[0].leaf, sha(""))]
    assert manifest.manifest(corpus(spark, one).where(F.lit(False))).count() == 0
