"""Conversation structure repair: the cheapest edits that make roles alternate, found once for each shared prefix.

A row's signature letter says its role (system, user, assistant by initial, or other) and its first fault (blank,
duplicate, truncated or none). A conversation's signature is the word of its letters; counts, cost and edits depend
on nothing else. The distinct signatures are sorted, so that those of one partition are a prefix trie read in order:
the layers of the dynamic programme stand on a stack, one a letter, and each signature goes on from the layer where it
leaves the one before. Answers are emitted where a signature ends and joined back by it.

A layer has the states of the target `(s?(ua)+)?`: nothing yet, after s, after u, after a. For each it holds the
least cost and the rank of the ASCII-least edits of that cost among the four; ranks suffice, as edits of equally many
rows never are prefixes of one another. Costs less their minimum and ranks take few values, so a layer is a number of
a table that fills as it is used, and a step is a lookup.

Order and first occurrences are found without texts: rows carry the SHA-256 of role and text, equal rows are combined
before they move, a table sorted by range numbers them, and first occurrences are grouped minima joined back by that
number. Neither step meets all rows of a long conversation in a task. The hash over a repaired conversation is
sequential by its nature: one task streams its rows in order, with its edits (a letter or two a row) in memory.

Defined cases: rows of one turn (and rows without turn, the first) stand by role, then by that SHA-256; an empty role is
of no allowed kind and illegal beside any; null role and text count as one space, null conv_id is a conversation of its
own; a conversation without rows after damage has zeros, an empty audit and the hash of nothing; repeated rows are
duplicates; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import released, stored, table
from quire.llm.manifest import CRC32

SPACE = " \t\n\x0b\x0c\r"
ROLES, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of `(s?(ua)+)?` and the state after each role, where it may stand.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The role that an inserted or re-roled row takes, by state; there is one each.
TAKES = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
#: Inserted rows that close a conversation, by state.
CLOSING = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}
#: A state that costs more than this above the least one is beaten in every future: two insertions lead from any state to
#: `after a`, which is as good as `nothing yet` and `after s` but for a system row, which it can delete.
BEATEN = 2 * INSERT + DELETE
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


def letter(role: str, fault: int) -> str:
    """The signature letter of a role kind and a fault number."""
    return chr(65 + 4 * fault + ROLES.index(role))


def meaning(symbol: str) -> tuple[str, int]:
    fault, role = divmod(ord(symbol) - 65, 4)
    return ROLES[role], fault


def inserted(state: int, rows: int) -> int:
    for _ in range(rows):
        state = NEXT[state, TAKES[state]]
    return state


def ways(state: int, symbol: str) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, edits) of one row from a state. Rows inserted just before a deletion are left to what follows: `DI` comes before `ID`."""
    role, fault = meaning(symbol)
    yield state, DELETE, "D"
    if fault in (1, 2):
        return
    extra = TRUNCATED if fault == 3 else 0
    for k in range(3):
        at = inserted(state, k)
        if (at, role) in NEXT:
            yield NEXT[at, role], k * INSERT + KEEP + extra, "I" * k + "K"
        yield NEXT[at, TAKES[at]], k * INSERT + REROLE + extra, "I" * k + "R"


Layer = tuple[tuple[int, int] | None, ...]


class Programme:
    """Layers by number, and the steps between them as they are met: next layer, growth of the least cost, and where each state came from."""

    def __init__(self):
        self.layers: list[Layer] = [((0, 0), None, None, None)]
        self.numbers = {self.layers[0]: 0}
        self.steps: dict[tuple[int, str], tuple[int, int, list]] = {}

    def step(self, number: int, symbol: str) -> tuple[int, int, list]:
        found = self.steps.get((number, symbol))
        if found is None:
            found = self.steps[number, symbol] = self._made(self.layers[number], symbol)
        return found

    def _made(self, layer: Layer, symbol: str) -> tuple[int, int, list]:
        best: list = [None] * 4
        for state, held in enumerate(layer):
            if held is None:
                continue
            for to, cost, edits in ways(state, symbol):
                way = (held[0] + cost, held[1], edits, state)
                if best[to] is None or way[:3] < best[to][:3]:
                    best[to] = way
        least = min(w[0] for w in best if w)
        best = [w if w and w[0] - least <= BEATEN else None for w in best]
        order = sorted((w[1:3], to) for to, w in enumerate(best) if w)
        rank = {to: k for k, (_, to) in enumerate(order)}
        made = tuple((w[0] - least, rank[to]) if w else None for to, w in enumerate(best))
        if made not in self.numbers:
            self.numbers[made] = len(self.layers)
            self.layers.append(made)
        return self.numbers[made], least, [w and (w[3], w[2]) for w in best]


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def solved(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, edits) of sorted signatures; the stack holds a layer number and a cost for each letter of the present one."""
    programme, before, numbers, costs = Programme(), "", [0], [0]
    for signature in signatures:
        shared = common_prefix(before, signature)
        del numbers[shared + 1 :], costs[shared + 1 :]
        for symbol in signature[shared:]:
            number, growth, _ = programme.step(numbers[-1], symbol)
            numbers.append(number)
            costs.append(costs[-1] + growth)
        cost, _, state = min((held[0] + INSERT * CLOSING[s], held[1], s) for s, held in enumerate(programme.layers[numbers[-1]]) if held)
        edits = ["I" * CLOSING[state]]
        for depth in range(len(signature), 0, -1):
            state, last = programme.step(numbers[depth - 1], signature[depth - 1])[2][state]
            edits.append(last)
        yield signature, costs[-1] + cost, "".join(reversed(edits))
        before = signature


ANSWER = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@released
def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANSWER rows of sorted signatures."""
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
    names = [c.split()[0] for c in ANSWER.split(", ")]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    for signature, cost, audit in solved(s for b in batches for s in b.column(0).to_pylist()):
        faults = [sum(map(signature.count, (letter(r, f) for r in ROLES))) for f in (1, 2, 3)]
        roles = "".join(ROLES[(ord(c) - 65) % 4] for c in signature)
        illegal = max(0, len(roles) - 1) - sum(len(re.findall(f"{a}(?={b})", roles)) for a, b in LEGAL)
        held.append((signature, *faults, illegal, cost, audit))
        size += len(signature) + len(audit)
        if len(held) >= 4096 or size > 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after damage, copies being 0 for a dropped row and 2 for a repeated one."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kind = F.crc32(key) % 20
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


ORDER = ("conv_id", "turn", "role", "digest")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps) of rows (conv_id, turn, role, text, copies), a row for each conversation."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    role = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    kind = F.when((F.col("role") == "") | (role == 0), 3).otherwise(role - 1)
    narrow = rows.select("conv_id", "turn", "role", digest().alias("digest"), kind.alias("kind"), fault.alias("fault"), "copies")
    equal = narrow.groupBy(*ORDER, "kind", "fault").agg(F.sum("copies").alias("copies"))
    ordered = equal.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("pos", F.monotonically_increasing_id())
    ordered = stored(ordered)
    first = ordered.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    marked = ordered.join(first, "pos", "left")

    def of(fault: Column | int) -> Column:
        return F.substring(F.lit("ABCDEFGHIJKLMNOP"), (4 * fault + F.col("kind") + 1) if isinstance(fault, Column) else (F.lit(4 * fault) + F.col("kind") + 1), F.lit(1))

    again = F.when(F.col("fault") == 1, of(1)).otherwise(of(2))
    rest = F.col("copies").cast("int")
    letters = F.when(F.col("copies") == 0, "").when(F.col("first"), F.concat(of(F.col("fault")), F.repeat(again, rest - 1))).otherwise(F.repeat(again, rest))
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    pieces = marked.groupBy("conv_id", F.shiftright("pos", 33).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", letters.alias("letters"), turn.alias("turn")))).alias("rows"))
    turns = F.array_compact(F.col("rows.turn"))
    pieces = pieces.select("conv_id", F.struct("block", F.array_join("rows.letters", "").alias("letters"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(F.array_distinct(turns)).cast("long").alias("turns")).alias("piece"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    # Blocks stand in the order of turns: a turn counted twice is the last of one block and the first of the next that has turns.
    with_turns = F.filter("p", lambda x: x["turns"] > 0)
    twice = F.aggregate(with_turns, F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("high")), lambda s, x: F.struct((s["n"] + F.when(s["high"] == x["low"], 1).otherwise(0)).alias("n"), x["high"].alias("high")))["n"]
    distinct = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["turns"]) - twice
    gaps = F.coalesce(F.array_max("p.high") - F.array_min("p.low") + 1 - distinct, F.lit(0))
    return whole.select("conv_id", F.array_join("p.letters", "").alias("signature"), gaps.alias("gaps"))


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None, str | None]]:
    """(answer, role, text) of every repaired row, in order, from rows sorted so that a conversation's answer comes before
    its rows; before the rows of a conversation comes (answer, None, None)."""
    answer, edits, at, state, left = None, "", 0, START, 0

    def closing() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(edits):
            role = TAKES[state]
            at, state = at + 1, NEXT[state, role]
            yield answer, NAMES[role], ""

    for batch in batches:
        for row in batch.to_pylist():
            if not row["is_row"]:
                yield from closing()
                answer, edits, at, state = row, row["audit"], 0, START
                yield answer, None, None
                continue
            for _ in range(row["copies"]):
                while edits[at] == "I":
                    role = TAKES[state]
                    at, state = at + 1, NEXT[state, role]
                    yield answer, NAMES[role], ""
                edit, at = edits[at], at + 1
                if edit == "K":
                    state = NEXT[state, row["role"][0]]
                    yield answer, row["role"], row["text"]
                elif edit == "R":
                    role = TAKES[state]
                    state = NEXT[state, role]
                    yield answer, NAMES[role], row["text"]
    yield from closing()


@released
def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OUT rows, one for each conversation."""
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    done, sha, present, any_row = [], None, None, False

    def finished() -> None:
        done.append((present["conv_id"], *(present[c] for c in COUNTS), sha.hexdigest()))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    for answer, role, text in repaired_rows(batches):
        if role is None:
            if present is not None:
                finished()
                if len(done) >= 4096:
                    yield out()
                    done.clear()
            present, sha, any_row = answer, hashlib.sha256(), False
            continue
        sha.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
        any_row = True
    if present is not None:
        finished()
    if done:
        yield out()


def in_sequence(rows: DataFrame) -> DataFrame:
    """For rows (conv_id, turn, role, text, copies): each conversation's answer, then its rows in order, conversations whole in a partition."""
    told = stored(signatures(rows))
    tried = told.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(answers, ANSWER)
    solved_ones = told.join(stored(tried), "signature")
    heads = solved_ones.select("conv_id", F.lit(False).alias("is_row"), *COUNTS)
    body = rows.where("copies > 0").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "text", "copies", digest().alias("digest"))
    both = heads.unionByName(body, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "digest").drop("digest")


def repairs(rows: DataFrame) -> DataFrame:
    """OUT rows of rows (conv_id, turn, role, text, copies)."""
    return in_sequence(rows).mapInArrow(hashed, OUT)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, pos, role, text), pos from 0."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, pos = [], 0
        for answer, role, text in repaired_rows(batches):
            if role is None:
                pos = 0
                continue
            done.append({"conv_id": answer["conv_id"], "pos": pos, "role": role, "text": text})
            pos += 1
            if len(done) >= 256:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema)

    schema = pa.schema({"conv_id": pa.int64(), "pos": pa.int64(), "role": pa.string(), "text": pa.string()})
    return in_sequence(rows).mapInArrow(written, "conv_id long, pos long, role string, text string")


def op11_trie_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The programme as a recursive table: a row a conversation and depth, four structs (cost, audit, text), the least of which is taken by order."""
    # Each state's candidates for one row: (from, condition, cost, edits, lines before the row's own, role of the row or '' for its own, deleted).
    roles = {"u": "user", "a": "assistant"}
    into: dict[int, list[str]] = {s: [] for s in range(4)}
    for state in range(4):
        held = f"w.s{state}"
        into[state].append(f"CASE WHEN {held}.c IS NOT NULL THEN {{'c': {held}.c + 4, 'e': {held}.e || 'D', 't': {held}.t}} END")
        at, lines = state, ""
        for k in range(3):
            for to, test, cost, edit, role in [*((NEXT[at, r], f"r.kind = '{r}'", 0, "K", "r.role") for r in "sua" if (at, r) in NEXT), (NEXT[at, TAKES[at]], "true", 3, "R", f"'{roles[TAKES[at]]}'")]:
                into[to].append(
                    f"CASE WHEN {held}.c IS NOT NULL AND r.fault NOT IN (1, 2) AND {test} THEN {{'c': {held}.c + {cost + 3 * k} + CASE WHEN r.fault = 3 THEN 3 ELSE 0 END, "
                    f"'e': {held}.e || '{'I' * k + edit}', 't': {held}.t || {lines or chr(39) * 2} || {role} || ':' || r.text || chr(10)}} END"
                )
            lines = (lines + " || " if lines else "") + f"'{roles[TAKES[at]]}:' || chr(10)"
            at = NEXT[at, TAKES[at]]
    states = ", ".join(f"list_min([{', '.join(into[s])}]) AS s{s}" for s in range(4))
    nothing = "CAST(NULL AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR))"
    ends = "[w.s0, {'c': w.s1.c + 6, 'e': w.s1.e || 'II', 't': w.s1.t || 'user:' || chr(10) || 'assistant:' || chr(10)}, {'c': w.s2.c + 3, 'e': w.s2.e || 'I', 't': w.s2.t || 'assistant:' || chr(10)}, w.s3]"
    crc = CRC32.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, range(CASE WHEN kind = 3 THEN 2 WHEN kind = 0 THEN 0 ELSE 1 END) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM o),
r AS (SELECT conv_id, turn, role, text, n, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS kind,
  CASE WHEN trimmed = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM p),
f AS (SELECT conv_id, turn, n, fault, lag(kind) OVER (PARTITION BY conv_id ORDER BY n) || kind AS pair FROM r),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM f GROUP BY conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST({{'c': 0, 'e': '', 't': ''}} AS STRUCT(c BIGINT, e VARCHAR, t VARCHAR)) AS s0, {nothing} AS s1, {nothing} AS s2, {nothing} AS s3 FROM c
  UNION ALL SELECT w.conv_id, r.n, {states} FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = w.n + 1),
b AS (SELECT w.conv_id, list_min(list_filter({ends}, lambda x: x.c IS NOT NULL)) AS best FROM w JOIN c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = c.rows)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(left(best.t, length(best.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""


QUERIES = {"op11_trie_repair": op11_trie_repair}
ORACLE_SQL = {"op11_trie_repair": _sql()}
