"""Repair of conversations against exhaustive search, dynamic programming in SQL, and on odd rows."""

import hashlib
import itertools
import random
import re

import pytest

from gridtally.llm import turns
from gridtally.llm.queries import op13_turns

SCHEMA = "conv_id long, turn long, role string, text string, audit string, at long"


def exhaustive(rows):
    """The least (cost, audit) over all edits of a few (initial, code) rows, at most two inserts in each gap, and their repaired roles."""
    best = None
    options = [[("D", 3, None)] + ([] if code == 2 else [("K", code, i), ("R", 2 + code, "u"), ("R", 2 + code, "a")]) for i, code in rows]
    gaps = [()] + [c for n in (1, 2) for c in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            out, audit, cost = "".join(ins[0]), "I" * len(ins[0]), 2 * sum(map(len, ins))
            for (letter, price, role), more in zip(edits, ins[1:]):
                out, audit, cost = out + (role or "") + "".join(more), audit + letter + "I" * len(more), cost + price
            if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("n", range(4))
def test_paths_are_the_cheapest_and_least(n):
    rng = random.Random(n)
    for _ in range(1 if n == 0 else 12):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([0, 0, 1, 2])) for _ in range(n)]
        found = turns.paths([i for i, _ in rows], [c for _, c in rows], turns.START)
        assert min(found[x] for x in (turns.START, turns.ASSISTANT) if x in found) == exhaustive(rows)


def same_as_sql(spark, duck, df, odd):
    got = sorted(map(str, map(tuple, turns.repair_report(df).collect())))
    duck.register(odd, df.select("conv_id", "turn", "role", "text").toArrow())
    assert got == sorted(map(str, duck.execute(turns.oracle(odd)).fetchall()))


def test_the_given_table(spark, duck, sf):
    got = sorted(map(str, map(tuple, op13_turns(spark, sf).collect())))
    assert got == sorted(map(str, duck.execute(turns.oracle()).fetchall()))


def rows_of(rng, conv, n):
    texts = ["Yes.", "No", "Why?", " \t", "", None, "Yes.", "x. \n", "word " * 20]
    return [(conv, rng.choice([i, i, i, None, i - 1]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]), rng.choice(texts) if i % 2 else f"turn {i}.", "z", 7) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 8])
def test_long_and_odd_conversations(spark, duck, monkeypatch, bits):
    """Conversations over many segments give what one segment gives."""
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits)
    rng = random.Random(5)
    rows = [r for c in range(12) for r in rows_of(rng, c, rng.randint(1, 9))] + rows_of(rng, 99, 700) + rows_of(rng, None, 40)
    rows += [(50, 0, "user", "Same.", "z", 7)] * 60 + [(51, None, None, None, None, None)]
    same_as_sql(spark, duck, spark.createDataFrame(rows, SCHEMA), f"odd{bits}")


def test_a_conversation_that_is_dropped_whole(spark):
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "", 0)], SCHEMA)
    (r,) = turns.repair_report(df).collect()
    assert tuple(r)[:8] == (gone, 0, 0, 0, 0, 0, 0, "") and r.repaired_sha256 == hashlib.sha256().hexdigest()
    assert turns.repair_report(df.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief.", "z", 0), (1, 1, "user", "Hi.", "z", 0), (1, 2, "user", "Hi.", "z", 0), (1, 3, "assistant", " ", "z", 0), (1, 5, "user", "More?", "z", 0), (2, 0, "assistant", "é" * 300_000 + ".", "z", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [(r.conv, r.turn, r.role, len(r.text)) for r in turns.repaired(df).collect()]
    assert [x for x in out if x[0] == "=1"] == [("=1", 0, "system", 9), ("=1", 1, "user", 3), ("=1", 5, "assistant", 5)]
    assert sorted(x for x in out if x[0] == "=2" and x[3]) == [("=2", 0, "assistant", 300_001)]
    r = next(x for x in turns.repair_report(df, spoil=False).collect() if x.conv_id == 1)
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (1, 1, 1, 0, 1, 8, "KKDDR")
