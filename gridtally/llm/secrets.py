"""Operator 5: secrets found through a trigram index, with DataFrame and SQL functions only.

From each rule's expression the literal runs that every match holds are derived, and from them a
Boolean query: for each run, one of its alternatives, of which all trigrams are there. The index
holds, for blocks of ids, the ids of the documents with each trigram that some query names; a
query intersects and unites these postings. Only its candidates are searched with the expression;
a rule without mandatory trigrams (hex) searches every text.

Spans are counted in code points, the end exclusive. They come from the texts between the matches:
split() and regexp_extract_all() walk the same matches, so lengths give the places.

Defined cases: a null text is empty; rows that share a doc_id share candidates, and each is then
searched by itself; a null doc_id is indexed like any other; extra columns are not read. Empty in, empty out.
"""

from __future__ import annotations

import itertools
import re._constants as c
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.session import checkpointed

BLOCK = 1024
#: Candidates are broadcast up to this number, so that no text is shuffled.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """kind names the spans; group's value must have least code points; base rules come first."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # runs of 24 or more are just the matches of [0-9a-f]+ that are kept
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def literal_runs(pattern: str, most: int = 64) -> list[set[str]]:
    """For each stretch of a pattern that is literal, the strings (in lower case) that it can be."""
    runs: list[set[str]] = []

    def options(op, value) -> set[str] | None:
        """All strings of an element, None if they are not a few."""
        if op is c.LITERAL:
            return {chr(value).lower()}
        if op is c.IN and value[0][0] is not c.NEGATE and all(o is c.LITERAL for o, _ in value):
            return {chr(v).lower() for _, v in value}
        if op is c.SUBPATTERN:
            return sequence(value[3])
        if op is c.BRANCH:
            each = [sequence(x) for x in value[1]]
            return None if None in each else set().union(*each)
        if op is c.MAX_REPEAT and value[1] == 1:
            inner = sequence(value[2])
            return None if inner is None else inner | ({""} if value[0] == 0 else set())
        return None

    def sequence(items) -> set[str] | None:
        out = {""}
        for op, value in items:
            some = options(op, value)
            if some is None or len(out) * len(some) > most:
                return None
            out = {a + b for a, b in itertools.product(out, some)}
        return out

    now = {""}
    for op, value in parser.parse(pattern):
        some = options(op, value)
        if some is not None and len(now) * len(some) <= most:
            now = {a + b for a, b in itertools.product(now, some)}
        else:
            runs.append(now)
            now = {""}
            if op is c.MAX_REPEAT and value[0] > 0 and (inner := sequence(value[2])) is not None:
                runs.append(inner)
    return [r for r in [*runs, now] if r != {""}]


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of these; of each, one alternative; of it, all trigrams. Empty: the rule must search every text."""
    query = []
    for run in literal_runs(pattern):
        if all(len(s) >= 3 for s in run):
            options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            query.append(sorted((o for o in options if not any(x < o for x in options)), key=sorted))
    return query


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, trigram, ids): the documents of a block of ids that hold a trigram, whatever its case."""
    lowered = docs.select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    held = lowered.select("doc_id", F.explode(present).alias("trigram"))
    return held.groupBy(F.floor(F.col("doc_id") / BLOCK).alias("block"), "trigram").agg(F.collect_set(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("ids"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds): the rules to search in each document that some query names; id is the doc_id as text."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted(set().union(*(a for q in queries.values() for run in q for a in run)))
    lists = postings(docs, trigrams).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("index"))
    none = F.array().cast("array<string>")

    def both(parts: list[Column], join) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return out

    def answer(query) -> Column:
        runs = []
        for run in query:
            options = [both([F.coalesce(F.element_at("index", F.lit(t)), none) for t in sorted(option)], F.array_intersect) for option in run]
            runs.append(both(options, F.array_union))
        return both(runs, F.array_intersect)

    named = lists.select(*(answer(q).alias(kind) for kind, q in queries.items()))
    each = named.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("ids")) for kind in queries))).alias("x"))
    return each.select("x.kind", F.explode("x.ids").alias("id")).groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's accepted matches as (start, order, end, kind)."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("hit"), value.alias("own")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["hit"]).alias("size"), (F.length(m["own"]) >= rule.least).alias("fits")))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["fits"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # a fold copies what it has gathered, so it goes over groups of about the root of their number of matches
    group = F.ceil(F.sqrt(F.greatest(F.lit(1), F.size(steps)))).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / group).cast("int")), lambda g: F.slice(steps, g * group + 1, group))
    widths = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
    begins = F.aggregate(widths, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    spans = F.zip_with(groups, F.slice(begins, F.lit(1), F.size(groups)), lambda g, at: F.aggregate(g, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"]))
    found = F.flatten(spans)
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast(kind))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) with the spans of all rules, by start, then by the order of the rules."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = candidates(docs, rules)
    named = checkpointed(named.withColumnRenamed("id", "_id"))
    if named.count() <= BROADCAST_IDS:  # else texts meet the candidates in a shuffle
        named = F.broadcast(named)
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).join(named, "_id", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, i)
        parts.append(F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none) if trigram_query(rule.pattern) else spans)
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def secret_digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from find_secrets."""
    base = [r.kind for r in rules if r.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(joined(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for secret_digest(find_secrets(documents)): every rule searches every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"SELECT rowid AS r, {i} AS o, {quoted(rule.kind)} AS kind, regexp_extract_all(coalesce(text, ''), {quoted(rule.pattern)}, 0) AS hits, regexp_extract_all(coalesce(text, ''), {quoted(rule.pattern)}, {rule.group}) AS own, regexp_split_to_array(coalesce(text, ''), {quoted(rule.pattern)}) AS gaps, {rule.least} AS least FROM d WHERE regexp_matches(coalesce(text, ''), {quoted(rule.pattern)})"
        for i, rule in enumerate(rules)
    ]
    base = ", ".join(quoted(r.kind) for r in rules if r.base)
    return f"""WITH d AS (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents), m AS ({' UNION ALL '.join(parts)}),
    e AS (SELECT r, o, kind, least, hits, own, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
    s AS (SELECT r, o, kind, length(own[i]) >= least AS fits, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(hits[i]) AS n FROM e),
    g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM s WHERE fits GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.rowid = g.r"""
