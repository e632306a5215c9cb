"""Personal data: patterns for what identifies by itself, and corpus co-occurrence for what gives it away.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers; secrets (long opaque tokens of letters and
digits) are protected too. Around these entities the method of information content works. The context of an entity is the text up
to `RADIUS` characters before and after it, on its line and up to the next match of its kind; a term is a word (a stretch
between white space without its edges that are no letters) that holds no digit and no @. Over all words of the corpus, P(c) is the
share that stands in a context of class c and P(c | t) that of the term t, smoothed by one occurrence at P(c); the disclosure of
c by t is PMI(t; c) / IC(c) = 1 + log P(c | t) / -log P(c): 1 where the term tells as much as the entity itself, 0 where
it tells nothing. Terms seen with at least `least_values` different values of the class (so copies of one passage are one piece of
evidence), and `sigmas` standard deviations more often than chance has it, are generalised from `generalise` on and removed
from `remove` on, wherever they stand in a context of the class.

DataFrame functions only. Regular expressions are written with possessive quantifiers and look-behind, so
that they find the same leftmost matches in linear time and without recursion; matches are placed in chunks, so that a text of many
matches takes linear time too. Word counts combine before the shuffle, and only slim rows (entities and their contexts)
are stored and joined; no whole text is shuffled by find_spans().

Defined cases: null text counts as empty and has no spans; repeated rows each get their spans; a null
doc_id is kept; empty tables give no rows; extra columns are ignored, and kept by sanitised(); a text of any length and number of
entities is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
PROTECTED = (*KINDS, "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"[A-Za-z0-9_-]{20,}+",
}
RADIUS = 40
WHITE = r"[\x20\x09-\x0D]"
DARK = r"[^\x20\x09-\x0D]"
WORD = r"(?s)^[^\p{L}]*(\p{L}.*\p{L})[^\p{L}]*\z"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"
ENTITY = "struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>"
#: Matches that are placed at a time.
CHUNK = 128


def _luhn(digits: Column) -> Column:
    doubled = F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))

    def step(acc, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.element_at(doubled, d + 1)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15),
        "secret": F.size(F.regexp_extract_all(found, F.lit("[A-Za-z][0-9]"), F.lit(0))) >= 2,
    }[kind]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, F.lit(CHUNK)))


def _placed(text: Column, pattern: str, kind: Column, valid: Callable[[Column], Column]) -> Column:
    """The valid matches of a pattern with their places and the texts around them, up to the next match: the gaps between matches and the matches' lengths add up to their places, chunk by chunk."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as array<{ENTITY}>)")
    size = lambda x: F.length(x["gap"]) + F.length(x["found"])

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        entity = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), x["found"].alias("value"), F.substring(x["gap"], -RADIUS - 1, RADIUS + 1).alias("before"), F.substring(x["next"], 1, RADIUS + 1).alias("after"))
        return F.struct(end.alias("at"), F.when(valid(x["found"]), F.concat(acc["out"], F.array(entity))).otherwise(acc["out"]).alias("out"))

    def in_chunk(chunk, start):
        return F.aggregate(chunk, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def placed(chunks):
        starts = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + size(x)))))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), in_chunk))

    def rows(found, gaps):
        return F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), F.slice(gaps, F.lit(2), F.size(found)).alias("next"))

    walked = _let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda m: _let(rows(m["found"], m["gaps"]), lambda r: _let(_chunks(r), placed)))
    return F.when(F.size(found) > 0, walked).otherwise(none)


def _entities(text: Column, kinds: tuple[str, ...]) -> Column:
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.expr(f"cast(array() as array<{ENTITY}>)")
    return F.concat(*(F.when(hint[k], s).otherwise(none) if k in hint else s for k in kinds for s in [_placed(text, PATTERNS[k], F.lit(k), lambda m, k=k: _valid(k, m))]))


def _spans(entities: Column, base: bool) -> Column:
    chosen = F.filter(entities, lambda e: e["kind"].isin(*KINDS) if base else ~e["kind"].isin(*KINDS))
    return F.transform(chosen, lambda e: F.struct(*(e[c].alias(c) for c in ("kind", "start", "end", "value"))))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then by start; starts and ends in code points."""
    return _spans(_entities(text, KINDS), True)


def with_entities(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, and the protected entities with the texts around them. Stored once and read by what follows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return stored(slim.select("doc_id", F.xxhash64("text").alias("text_hash"), _entities(F.col("text"), PROTECTED).alias("entities")))


def _term(word: Column) -> Column:
    """The term of a word between white space, or an empty text."""
    return F.when(word.rlike("[0-9@]"), "").otherwise(F.lower(F.regexp_extract(word, WORD, 1)))


def _contexts(entity: Column) -> Column:
    """The two contexts of an entity, their starts and texts: on its line, without the words that are cut off or touch the entity."""
    before, after = F.regexp_extract(entity["before"], r"[^\n]*\z", 0), F.regexp_extract(entity["after"], r"^[^\n]*", 0)
    before = F.when(F.length(before) > RADIUS, F.regexp_replace(before, f"^{DARK}*", "")).otherwise(before)
    after = F.when(F.length(after) > RADIUS, F.regexp_replace(after, rf"{DARK}*\z", "")).otherwise(after)
    free = F.regexp_replace(after, f"^{DARK}+", "")
    return F.array(
        F.struct((entity["start"] - F.length(before)).alias("start"), F.regexp_replace(before, rf"{DARK}+\z", "").alias("text")),
        F.struct((entity["end"] + F.length(after) - F.length(free)).alias("start"), free.alias("text")),
    )


def occurrences(entities: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, entity (a hash of its value), term, start, end and value of every term in a context."""
    each = entities.select("doc_id", "text_hash", F.explode("entities").alias("e"))
    parts = each.select("doc_id", "text_hash", F.col("e.kind").alias("kind"), F.xxhash64("e.value").alias("entity"), F.explode(_contexts(F.col("e"))).alias("c")).where("c.text <> ''")
    words = parts.select("doc_id", "text_hash", "kind", "entity", F.col("c.start").alias("at"), F.explode(_placed(F.col("c.text"), f"{DARK}+", F.lit("word"), lambda m: F.lit(True))).alias("w"))
    terms = words.withColumn("term", _term(F.col("w.value"))).where("term <> ''")
    start = F.col("at") + F.col("w.start") + F.length(F.regexp_extract("w.value", r"^[^\p{L}]*", 0))
    return terms.select("doc_id", "text_hash", "kind", "entity", "term", start.alias("start"), (start + F.length("term")).alias("end"), F.regexp_extract("w.value", WORD, 1).alias("value"))


def term_disclosure(docs: DataFrame, found: DataFrame, *, least_values: int = 3, sigmas: float = 4.0) -> DataFrame:
    """kind, term and disclosure for every term with enough evidence, over all words of the corpus. found: occurrences()."""
    near = found.groupBy("kind", "term").agg(F.count_distinct("doc_id", "text_hash", "start").alias("n_both"), F.count_distinct("entity").alias("n_values"))
    raw = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), f"{WHITE}+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    everywhere = raw.withColumn("term", _term(F.col("word"))).where("term <> ''").groupBy("term").agg(F.sum("n").alias("n_term"))
    everywhere = stored(everywhere)
    kinds = near.groupBy("kind").agg(F.sum("n_both").alias("n_kind"))
    total = everywhere.agg(F.sum("n_term").alias("n_all"))
    # `kinds` has five rows at most and `total` one
    joined = near.where(F.col("n_values") >= least_values).join(everywhere, "term").join(F.broadcast(kinds), "kind").crossJoin(F.broadcast(total))
    shared = joined.withColumn("p", F.col("n_kind") / F.col("n_all")).withColumn("both", F.least("n_both", "n_term"))
    more = shared.where((F.col("p") < 1) & (F.col("both") - F.col("n_term") * F.col("p") >= sigmas * F.sqrt(F.col("n_term") * F.col("p"))))
    return more.select("kind", "term", (1 + F.log2((F.col("both") + F.col("p")) / (F.col("n_term") + 1)) / -F.log2("p")).alias("disclosure"))


def find_spans(docs: DataFrame, *, least_values: int = 3, sigmas: float = 4.0, generalise: float = 0.75, remove: float = 0.9) -> DataFrame:
    """doc_id, text_hash, base, and terms: the spans that the method adds, by kind ("generalise", "remove", "secret"), then start."""
    entities = with_entities(docs)
    found = stored(occurrences(entities))
    told = term_disclosure(docs, found, least_values=least_values, sigmas=sigmas).where(F.col("disclosure") >= generalise)
    actions = told.select("kind", "term", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))
    hits = found.join(actions, ["kind", "term"]).groupBy("doc_id", "text_hash", "start", "end", "value").agg(F.max("action").alias("kind"))
    terms = hits.groupBy(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash")).agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("terms"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    both = entities.join(terms, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")), "left")
    return both.select("doc_id", "text_hash", _spans(F.col("entities"), True).alias("base"), F.array_sort(F.concat(F.coalesce("terms", none), _spans(F.col("entities"), False))).alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _united(spans: Column) -> Column:
    """Spans in order of start, those that overlap as one with the kind of the first; how far the spans before it reach is known chunk by chunk."""
    none = F.expr("cast(array() as array<struct<start:bigint,kind:string,reach:bigint>>)")
    reach = lambda of: F.array_max(F.transform(of, lambda s: s["end"]))

    def step(acc, s):
        lead = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), acc["reach"].alias("reach"))
        return F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), F.when(s["start"] >= acc["reach"], F.concat(acc["out"], F.array(lead))).otherwise(acc["out"]).alias("out"))

    def leads(chunks):
        before = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, c: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), reach(c)))))
        found = F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, r: F.aggregate(c, F.struct(r.alias("reach"), none.alias("out")), step, lambda acc: acc["out"])))
        return F.struct(found.alias("leads"), F.array_max(F.transform(chunks, reach)).alias("end"))

    def whole(m):
        ends = F.concat(F.transform(F.slice(m["leads"], F.lit(2), F.size(m["leads"])), lambda x: x["reach"]), F.array(m["end"]))
        return F.zip_with(m["leads"], ends, lambda x, end: F.struct(x["start"].alias("start"), end.alias("end"), x["kind"].alias("kind")))

    return _let(_let(_chunks(spans), leads), whole)


def _replaced(text: Column, spans: Column) -> Column:
    """text with its united spans replaced by their names; a chunk of spans reads its own part of the text only."""
    names = F.create_map(*(F.lit(x) for k in PROTECTED for x in (k, f"[{k.upper()}]")), F.lit("generalise"), F.lit("[TERM]"), F.lit("remove"), F.lit(""))
    part = lambda of, start, size: F.substring(of, (start + 1).cast("int"), size.cast("int"))

    def in_chunk(chunk, start, stop):
        def body(own):
            def step(acc, s):
                return F.struct(s["end"].alias("at"), F.concat(acc["out"], part(own, acc["at"] - start, s["start"] - acc["at"]), F.element_at(names, s["kind"])).alias("out"))

            return F.aggregate(chunk, F.struct(start.alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], part(own, acc["at"] - start, stop - acc["at"])))

        return _let(part(text, start, stop - start), body)

    def whole(chunks):
        first = F.transform(chunks, lambda c: F.element_at(c, 1)["start"])
        starts = F.concat(F.array(F.lit(0).cast("long")), F.slice(first, F.lit(2), F.size(first)))
        stops = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.length(text).cast("long")))
        return F.array_join(F.transform(F.arrays_zip(chunks.alias("c"), starts.alias("start"), stops.alias("stop")), lambda x: in_chunk(x["c"], x["start"], x["stop"])), "")

    return _let(_united(spans), lambda m: _let(_chunks(m), whole))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with their columns and every span in text replaced: [EMAIL], [IP], [CARD], [PHONE], [SECRET], [TERM] for a generalised term, nothing for a removed one.

    Overlapping spans are replaced as one, by the name of the one that starts first. n_chars follows the new text if there is such a column.
    """
    spans = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = find_spans(docs, **options).where((F.size("base") > 0) | (F.size("terms") > 0)).select("doc_id", "text_hash", spans.alias("found")).distinct()
    new = _replaced(F.col("row.text"), F.col("found"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column of docs can clash
    joined = rows.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("text_hash")), "left")
    changed = joined.select("row", F.col("found").isNotNull().alias("hit"), F.when(F.col("found").isNotNull(), new).otherwise(F.col("row.text")).alias("new"))
    out = {c: F.col(f"row.{c}") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("hit"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return changed.select(*(x.alias(c) for c, x in out.items()))


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: n_secret, n_terms (generalised or removed) and n_spans, all spans of a document."""
    found = find_spans(table(spark, sf_dir, "documents"))
    count = lambda of, *kinds: F.size(F.filter(of, lambda s: s["kind"].isin(*kinds))).cast("long")
    base = [count("base", k).alias(f"n_{k}") for k in KINDS]
    added = [count("terms", "secret").alias("n_secret"), count("terms", "generalise", "remove").alias("n_terms"), (F.size("base") + F.size("terms")).cast("long").alias("n_spans")]
    return found.select("doc_id", *base, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "terms")).alias("spans"), *added)


def _sql_spans(kind: str, order: int, pattern: str, valid: str) -> str:
    """The matches of a kind with their places, and the texts before and after up to the next match."""
    return f"""SELECT doc_id, {order} AS k, '{kind}' AS kind, e - length(m) AS s, e, m, right(g, {RADIUS + 1}) AS b, left(a, {RADIUS + 1}) AS a FROM (
  SELECT doc_id, m, g, a, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(gs[2:len(ms) + 1]) AS a, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM d)))
  WHERE {valid}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST({_DIGITS}[-i] AS INT) + 1] ELSE CAST({_DIGITS}[-i] AS INT) END)) % 10 = 0"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

QUERIES = {"op1_disclosure": op1_disclosure}
ORACLE_SQL = {
    "op1_disclosure": "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\nb AS MATERIALIZED ("
    + "\nUNION ALL ".join((
        _sql_spans("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_spans("ip", 2, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(m, '{_OCTET}(\.{_OCTET}){{3}}')"),
        _sql_spans("card", 3, r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
        _sql_spans("phone", 4, r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        _sql_spans("secret", 5, "[A-Za-z0-9_-]{20,}", "len(regexp_extract_all(m, '[A-Za-z][0-9]')) >= 2"),
    ))
    + rf"""),
lines AS (SELECT doc_id, kind, s, e, m, regexp_extract(b, '[^\n]*\z') AS b, regexp_extract(a, '^[^\n]*') AS a FROM b),
cuts AS (SELECT doc_id, kind, s, e, m, CASE WHEN length(b) > {RADIUS} THEN regexp_replace(b, '^{DARK}*', '') ELSE b END AS b, CASE WHEN length(a) > {RADIUS} THEN regexp_replace(a, '{DARK}*\z', '') ELSE a END AS a FROM lines),
parts AS MATERIALIZED (SELECT doc_id, kind, m, s - length(b) AS p0, regexp_replace(b, '{DARK}+\z', '') AS t FROM cuts
  UNION ALL SELECT doc_id, kind, m, e + length(a) - length(regexp_replace(a, '^{DARK}+', '')), regexp_replace(a, '^{DARK}+', '') FROM cuts),
words AS MATERIALIZED (SELECT doc_id, kind, m, w, p0 + sum(length(g) + length(w)) OVER (PARTITION BY doc_id, kind, m, p0, t, copy ORDER BY i) - length(w) AS ws FROM (
  SELECT doc_id, kind, m, p0, t, copy, unnest(regexp_extract_all(t, '{DARK}+')) AS w, unnest(regexp_split_to_array(t, '{DARK}+')[1:len(regexp_extract_all(t, '{DARK}+'))]) AS g, unnest(range(len(regexp_extract_all(t, '{DARK}+')))) AS i
  FROM (SELECT *, row_number() OVER () AS copy FROM parts))),
occ AS MATERIALIZED (SELECT DISTINCT doc_id, kind, m, lower(regexp_extract(w, '{WORD}', 1)) AS term, ws + length(regexp_extract(w, '^[^\p{{L}}]*')) AS s FROM words WHERE NOT regexp_matches(w, '[0-9@]') AND regexp_extract(w, '{WORD}', 1) <> ''),
near AS (SELECT kind, term, count(DISTINCT (doc_id, s)) AS n_both, count(DISTINCT m) AS n_values FROM occ GROUP BY kind, term),
kinds AS (SELECT kind, sum(n_both) AS n_kind FROM near GROUP BY kind),
every AS (SELECT lower(regexp_extract(w, '{WORD}', 1)) AS term, count(*) AS n_term FROM (SELECT unnest(regexp_split_to_array(text, '{WHITE}+')) AS w FROM d) WHERE NOT regexp_matches(w, '[0-9@]') AND regexp_extract(w, '{WORD}', 1) <> '' GROUP BY ALL),
stat AS (SELECT kind, term, least(n_both, n_term)::DOUBLE AS n, n_term::DOUBLE AS n_term, n_kind / (SELECT sum(n_term) FROM every) AS p FROM near JOIN kinds USING (kind) JOIN every USING (term) WHERE n_values >= 3),
told AS (SELECT kind, term, 1 + log2((n + p) / (n_term + 1)) / -log2(p) AS disclosure FROM stat WHERE p < 1 AND n - n_term * p >= 4 * sqrt(n_term * p)),
hit AS (SELECT doc_id, 6 AS k, max(CASE WHEN disclosure >= 0.9 THEN 'remove' ELSE 'generalise' END) AS kind, s, s + length(term) AS e FROM occ JOIN told USING (kind, term) WHERE disclosure >= 0.75 GROUP BY doc_id, s, term),
added AS (SELECT doc_id, k, kind, s, e FROM b UNION ALL SELECT doc_id, k, kind, s, e FROM hit),
j AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE k < 5) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY least(k, 5), CASE WHEN k > 4 THEN kind END, s) AS spans,
  count(*) FILTER (WHERE k = 1) AS n_email, count(*) FILTER (WHERE k = 2) AS n_ip, count(*) FILTER (WHERE k = 3) AS n_card, count(*) FILTER (WHERE k = 4) AS n_phone, count(*) FILTER (WHERE k = 5) AS n_secret, count(*) FILTER (WHERE k = 6) AS n_terms, count(*) AS n_spans FROM added GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_secret, 0) AS n_secret, coalesce(n_terms, 0) AS n_terms, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN j USING (doc_id)""",
}
