"""Operator 13: repair of conversations by the cheapest edits, found with A* on an edit lattice.

A node of the lattice is (rows consumed, what the last turn kept was); moves keep, rerole, delete or insert a turn, and a
repaired conversation is an optional system turn, then user and assistant in turn. The heuristic is a suffix sum: what rows
that must be deleted cost, and a charge of 1 for each truncated row, which is unavoidable as deleting one costs more. It is
consistent, and the heap is keyed (cost plus heuristic, audit), so the first visit to a node has the least cost and of those the least audit.
No audit to a node is the beginning of another one of equal cost, so the least audit is made of least pieces.

Rows are sorted by conversation and turn over all tasks and cut into segments of SEGMENT rows. A*
runs from every entry state to every exit state of a segment, and segments are folded in order, with what all
surviving paths share decided at once. So a conversation of any length is many tasks and no task gathers it; only its audit, which
is one value of the result, and its SHA-256, which is sequential, belong to one task, which takes rows as a stream.

Defined cases: a null role or text is one space; so are a null id and turn where damage is drawn. Rows of one turn go by role, then by the MD5 digest of
their text. A null id is a conversation of its own. A role of other initials can't be kept; one without an initial (the empty role) can
stand anywhere, as it adds none. Two texts count as equal by a 128-bit digest of role and text. Further columns stay out. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.texts import WORD
from gridtally.session import checkpointed

SEGMENT_BITS = 8
SEGMENT = 1 << SEGMENT_BITS
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant; a repaired conversation ends in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: The state that an inserted or reroled turn leads to.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
SPACES = " \t\n\x0b\x0c\r"
#: Codes of rows: whole, truncated, and to be deleted.
WHOLE, CUT, GONE = range(3)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a fifth of the rows spoilt, drawn by the CRC of their place."""
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    draw = F.crc32(place.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    spoilt = rows.select("conv_id", "turn", draw.alias("draw"), F.when(draw == 4, "user").otherwise(role).alias("role"), F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    times = F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1)
    return spoilt.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select("conv_id", "turn", "role", "text")


def _key(column: str) -> Column:
    """A conversation's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, at, block, turn, role, text): rows in the order of conversation and turn; at ascends, block is at's segment."""
    keyed = rows.select(_key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # equal rows are told apart, so that many of them can lie in several ranges
    keyed = keyed.withColumn("digest", F.md5("text")).withColumn("number", F.monotonically_increasing_id())
    by = ["conv", "turn", "role", "digest", "number"]
    sorted_ = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    return checkpointed(sorted_.select("conv", at.alias("at"), F.shiftright(at, SEGMENT_BITS).alias("block"), "turn", "role", "text"))


def segments(rows: DataFrame) -> DataFrame:
    """(conv, block, rows, firsts): each segment's rows without their texts, and the places of rows that no earlier one equals."""
    blank = ~F.col("text").rlike(WORD)
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    marks = rows.select("conv", "block", "at", "turn", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), digest.alias("digest"))
    firsts = marks.filter("not blank").groupBy("conv", "digest").agg(F.min("at").alias("first"))
    row = F.struct("at", "turn", "initial", "blank", "cut")
    both = marks.select("conv", "block", row.alias("row"), F.lit(None).cast("long").alias("first")).unionByName(firsts.select("conv", F.shiftright("first", SEGMENT_BITS).alias("block"), "first"), allowMissingColumns=True)
    return both.groupBy("conv", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.collect_list("first").alias("firsts"))


def paths(initials: list[str], codes: list[int], entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from an entry state over all rows to each state that can be reached."""
    n = len(codes)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if codes[i] == GONE else TRUNCATED if codes[i] == CUT else 0)
    heap, done, out = [(ahead[0], "", 0, entry)], set(), {}
    while heap:
        most, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = most - ahead[i]
        if i == n:
            out[state] = (cost, audit)
        # inserts turn in a circle of two states, which done stops
        heapq.heappush(heap, (most + INSERT, audit + "I", i, NEXT[state]))
        if i < n:
            then = cost + ahead[i + 1]
            heapq.heappush(heap, (then + DELETE, audit + "D", i + 1, state))
            if codes[i] != GONE:
                then += TRUNCATED if codes[i] == CUT else 0
                kept = AFTER.get((initials[i], state)) if initials[i] else state
                if kept is not None:
                    heapq.heappush(heap, (then, audit + "K", i + 1, kept))
                heapq.heappush(heap, (then + REROLE, audit + "R", i + 1, NEXT[state]))
    return out


COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
MAPS = "conv string, block long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, last_turn long, first_turn long, head string, tail string, ways array<struct<entry:int,exit:int,cost:long,audit:string>>"


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _streamed(rows: DataFrame, run, ddl: str) -> DataFrame:
    """run, a function of an iterator of rows as dicts to another one, over each task's rows."""
    schema = _arrow(ddl)

    def task(batches):
        yield from _batches(run(r for b in batches for r in b.to_pylist()), schema)

    return rows.mapInArrow(task, ddl)


def _measured(rows: Iterator[dict]) -> Iterator[dict]:
    """A segment's counts and its ways from state to state."""
    for s in rows:
        firsts, initials, codes = set(s["firsts"]), [r["initial"] for r in s["rows"]], []
        count = dict.fromkeys(COUNTS, 0)
        for r in s["rows"]:
            fault = "blank" if r["blank"] else "duplicate" if r["at"] not in firsts else "truncated" if r["cut"] else None
            if fault:
                count[fault] += 1
            codes.append(WHOLE if not fault else CUT if fault == "truncated" else GONE)
        count["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = sorted({r["turn"] for r in s["rows"] if r["turn"] is not None})
        count["turns"] = len(turns)
        ends = {"low": turns[0], "high": turns[-1], "first_turn": turns[0], "last_turn": turns[-1]} if turns else dict.fromkeys(("low", "high", "first_turn", "last_turn"))
        ways = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in range(4) for x, (c, a) in paths(initials, codes, e).items()]
        yield {"conv": s["conv"], "block": s["block"], "head": initials[0], "tail": initials[-1], "ways": ways} | count | ends


FOLDED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, pieces array<struct<block:long,entry:int,audit:string>>"


def _folded(rows: Iterator[dict]) -> Iterator[dict]:
    """Conversations from their segments in order."""
    conv, live = None, {}

    def ended():
        tail = min((live[x] for x in (START, ASSISTANT) if x in live), key=lambda p: (p[0], "".join(a for _, _, a in p[1])))
        gaps = count["high"] - count["low"] + 1 - count["turns"] if count["turns"] else 0
        pieces = [{"block": b, "entry": e, "audit": a} for b, e, a in decided + tail[1]]
        return {"conv": conv, "gaps": gaps, "cost": tail[0], "pieces": pieces} | {k: count[k] for k in COUNTS[:4]}

    for s in rows:
        if s["conv"] != conv:
            if live:
                yield ended()
            conv, live, decided = s["conv"], {START: (0, [])}, []
            count = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None}
            tail, turn = None, None
        for k in COUNTS:
            count[k] += s[k]
        if tail is not None:
            count["illegal"] += tail + s["head"] not in ("su", "ua", "au")
        if s["low"] is not None:
            count["turns"] -= turn is not None and turn == s["first_turn"]
            count["low"] = s["low"] if count["low"] is None else min(count["low"], s["low"])
            count["high"], turn = s["high"], s["last_turn"]
        tail = s["tail"]
        reached: dict[int, list] = {}
        for w in s["ways"]:
            if w["entry"] in live:
                cost, pieces = live[w["entry"]]
                reached.setdefault(w["exit"], []).append((cost + w["cost"], [*pieces, (s["block"], w["entry"], w["audit"])]))
        live = {x: p[0] if len(p) == 1 else min(p, key=lambda q: (q[0], "".join(a for _, _, a in q[1]))) for x, p in reached.items()}
        # what all surviving paths begin with is decided
        while all(p[1] for p in live.values()) and len({p[1][0] for p in live.values()}) == 1:
            decided.append(next(iter(live.values()))[1][0])
            live = {x: (c, p[1:]) for x, (c, p) in live.items()}
    if live:
        yield ended()


def plans(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, pieces) for the conversations of ordered rows."""
    maps = _streamed(segments(rows), _measured, MAPS)
    return _streamed(maps.repartition("conv").sortWithinPartitions("conv", "block"), _folded, FOLDED)


EDITED = "conv string, at long, turn long, role string, text string"


def _edited(rows: Iterator[dict]) -> Iterator[dict]:
    """The turns of repaired conversations. Before its rows comes each segment's piece of the audit, in `text`, with its entry state in `turn`."""
    piece, at, state = "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(piece) and piece[at] == "I":
            at, state = at + 1, NEXT[state]
            yield {"conv": r["conv"], "at": r["at"], "turn": None, "role": ROLE[state], "text": ""}

    for r in rows:
        if r["at"] < 0:
            piece, at, state = r["text"], 0, r["turn"]
            continue
        yield from inserted()
        edit, at = piece[at], at + 1
        if edit != "D":
            role = r["role"]
            if edit == "R":
                state = NEXT[state]
                role = ROLE[state]
            elif role:
                state = AFTER[role[0], state]
            yield {"conv": r["conv"], "at": r["at"], "turn": r["turn"], "role": role, "text": r["text"]}
        if "I" in piece[at:] and not piece[at:].strip("I"):  # behind the segment's last row
            yield from inserted()


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    conv, sha = None, None
    for r in _edited(rows):
        if r["conv"] != conv:
            if sha:
                yield {"conv": conv, "repaired_sha256": sha.hexdigest()}
            conv, sha = r["conv"], hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
    if sha:
        yield {"conv": conv, "repaired_sha256": sha.hexdigest()}


def _guided(rows: DataFrame, planned: DataFrame, *keys: str) -> DataFrame:
    """Ordered rows, each segment behind its piece of the audit, dealt by keys."""
    pieces = planned.select("conv", F.explode("pieces").alias("p"))
    guides = pieces.select("conv", F.lit(-1).cast("long").alias("at"), F.col("p.block").alias("block"), F.col("p.entry").cast("long").alias("turn"), F.lit("").alias("role"), F.col("p.audit").alias("text"))
    return guides.unionByName(rows).repartition(*keys).sortWithinPartitions("conv", "block", "at")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, at, turn, role, text): the turns of all repaired conversations, in the order of at; inserted ones have no turn number.

    An inserted turn and the row that it stands beside share an `at` and come in this order within a task.
    """
    rows = ordered(rows)
    return _streamed(_guided(rows, plans(rows), "conv", "block"), _edited, EDITED)


def repair_report(conversations: DataFrame, spoil: bool = True) -> DataFrame:
    """A row for each conv_id: faults found, the edits' cost and audit, and the digest of the repaired conversation."""
    rows = ordered(damaged(conversations) if spoil else conversations)
    planned = checkpointed(plans(rows))
    hashes = _streamed(_guided(rows, planned, "conv"), _hashed, "conv string, repaired_sha256 string")
    every = conversations.select("conv_id").distinct().withColumn("conv", _key("conv_id"))
    audit = F.array_join(F.transform("pieces", lambda p: p["audit"]), "")
    found = every.join(planned.withColumn("audit", audit).drop("pieces"), "conv", "left").join(hashes, "conv", "left")
    none = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.select("conv_id", *none.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL of `repair_report`: the same damage, and dynamic programming over rows in place of A*."""
    return f"""
    WITH RECURSIVE crc AS (
      SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    drawn AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw FROM {table}, crc),
    spoilt AS (
      SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM drawn, range(2) AS copies(k) WHERE draw <> 0 AND (k = 0 OR draw = 3)),
    placed AS (
      SELECT *, coalesce('=' || conv_id, '') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS initial FROM spoilt),
    marked AS (
      SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS open, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
    coded AS (
      SELECT *, CASE WHEN blank OR again THEN 2 WHEN open THEN 1 ELSE 0 END AS code FROM marked),
    inserts(a, b, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
    edits(a, b, letter, initial) AS (
      SELECT s, s, 'D', NULL FROM range(4) t(s) UNION ALL SELECT s, s, 'K', '' FROM range(4) t(s)
      UNION ALL VALUES (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'), (0, 2, 'R', NULL), (1, 2, 'R', NULL), (3, 2, 'R', NULL), (2, 3, 'R', NULL)),
    -- the least cost, nine digits, and audit of each state behind row i
    best AS (
      SELECT conv, 0::BIGINT AS i, 0 AS state, '000000000' AS way FROM coded GROUP BY conv
      UNION ALL
      SELECT c.conv, c.i, e.b, min(lpad((left(p.way, 9)::BIGINT + 2 * n.n + CASE e.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.letter <> 'D' THEN c.code ELSE 0 END)::VARCHAR, 9, '0') || substr(p.way, 10) || repeat('I', n.n) || e.letter)
      FROM best p JOIN coded c ON c.conv = p.conv AND c.i = p.i + 1 JOIN inserts n ON n.a = p.state JOIN edits e ON e.a = n.b AND (e.initial IS NULL OR e.initial = c.initial) AND (c.code < 2 OR e.letter = 'D')
      GROUP BY c.conv, c.i, e.b),
    counts AS (
      SELECT conv, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (code = 1) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv),
    ended AS (
      SELECT b.conv, min(lpad((left(way, 9)::BIGINT + 2 * n.n)::VARCHAR, 9, '0') || substr(way, 10) || repeat('I', n.n)) AS way
      FROM best b JOIN counts c ON c.conv = b.conv AND c.n = b.i JOIN inserts n ON n.a = b.state AND n.b IN (0, 3) GROUP BY b.conv),
    letters AS (
      SELECT conv, p, substr(way, 9 + p, 1) AS letter FROM ended, unnest(range(1, length(way) - 8)) AS u(p)),
    steps AS (
      SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY p) AS i FROM letters),
    turns AS (
      SELECT s.conv, s.p, s.letter, c.role, c.text, sum(CASE WHEN letter IN ('I', 'R') OR letter = 'K' AND c.initial IN ('u', 'a') THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv ORDER BY s.p) AS spoken
      FROM steps s LEFT JOIN coded c ON c.conv = s.conv AND c.i = s.i WHERE letter <> 'D'),
    joined AS (
      SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN spoken % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS whole FROM turns GROUP BY conv)
    SELECT d.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
      coalesce(left(e.way, 9)::BIGINT, 0) AS cost, coalesce(substr(e.way, 10), '') AS audit, sha256(coalesce(j.whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS conv FROM {table}) d LEFT JOIN counts c ON c.conv = d.conv LEFT JOIN ended e ON e.conv = d.conv LEFT JOIN joined j ON j.conv = d.conv
    """
