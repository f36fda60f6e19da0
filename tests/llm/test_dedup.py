"""Operators 2, 4 and 9 against brute force."""

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gridtally.llm.fingerprints import exact_copies, fingerprints
from gridtally.llm.line_dedup import LEAST_WORDS, WINDOW, Prints, drop_repeats
from gridtally.llm.links import forest
from gridtally.llm.near_dedup import near_classes

WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "or", "it", "u")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, component_id string")


def corpus():
    rng = random.Random(5)
    base, family = prose(rng, 120), prose(rng, 100)
    rows = [(i, prose(rng, rng.randint(1, 90))) for i in range(40)]
    rows += [(100 + i, base) for i in range(8)] + [(120, base.upper()), (121, base + " more")]
    for i in range(60):  # edited copies of one text: some linked, some not
        words = family.split()
        for k in rng.sample(range(100), rng.choice([1, 2, 3, 5, 8])):
            words[k] = rng.choice(WORDS) + "x"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "One  two"), (305, "one two three"), (None, base), (306, "a b c d " * 3000)]
    return rows


def classes(rows, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets if i is not None}


def test_near_classes(spark):
    rows = corpus()
    for width in (4, 5):
        got = near_classes(docs(spark, rows), width=width).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == classes(rows, width)
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_classes_of_rows_that_share_an_id(spark):
    rng = random.Random(6)
    a, b = prose(rng, 50), prose(rng, 50)
    got = near_classes(docs(spark, [(1, a), (2, a), (2, b), (3, b), (4, prose(rng, 50))])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)} and len(got) == 5


def test_near_classes_empty(spark):
    assert near_classes(docs(spark, [])).count() == 0


def test_forest(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in forest(links).collect())
    assert got == {i: 1 for i in range(2, 31)} | {50: 40, 60: 40}


def test_forest_of_a_long_chain_and_its_bound(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)], "a long, b long")
    assert dict(tuple(r) for r in forest(links).collect()) == {i: 1 for i in range(2, 201)}
    with pytest.raises(RuntimeError):
        forest(links, rounds=1)


def grams(texts, k):
    found = {}
    for i, t in texts.items():
        w = (t or "").split()
        for j in range(len(w) - k + 1):
            found.setdefault(" ".join(w[j : j + k]), set()).add(i)
    return found


def test_line_dedup(spark):
    rng = random.Random(7)
    passage, block = prose(rng, 70), "\n".join(prose(rng, 9) for _ in range(8))
    rows = {i: prose(rng, 60) for i in range(20)}
    rows[30] = prose(rng, 31) + " " + passage + " " + prose(rng, 30)  # in the midst of a line
    rows[31] = prose(rng, 12) + " " + passage + "\n" + prose(rng, 25)
    rows[32] = block + "\n" + prose(rng, 40)
    rows[33] = prose(rng, 20) + "\n" + block
    rows[34] = rows[33]
    rows[35] = "short line\nshort line"
    rows |= {40: None, 41: "", 42: prose(rng, 5) + "\n" + "long " * 20_000}
    frame = spark.createDataFrame([(i, t, i * 2) for i, t in rows.items()], "doc_id long, text string, found long")
    got = {r.doc_id: r.text for r in drop_repeats(frame).collect()}
    assert not any(len(v) > 1 for v in grams(got, 50).values())
    assert 34 not in got  # nothing of it is left
    assert all(got[i] == rows[i] for i in [*range(20), 30, 32, 35, 40, 41])  # first copies and clean texts
    assert len(got[31].split()) < 37 + 20 and len(got[33].split()) < 20 + 20
    kept = grams(got, 4)
    lost = [g for g in grams({i: rows[i] for i in (30, 32)}, 4) if g not in kept]
    assert not lost
    whole = {r.doc_id: r.found for r in drop_repeats(frame, drop_emptied=False).collect()}
    assert whole == {i: i * 2 for i in rows}
    assert LEAST_WORDS <= 50


def words_of_earlier_runs(texts, least):
    """Places of words in runs of least words that stand at an earlier place, by document."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        w, out[i] = (t or "").split(), set()
        for j in range(len(w) - least + 1):
            run = tuple(w[j : j + least])
            if run in seen:
                out[i].update(range(j, j + least))
            seen.add(run)
    return out


def test_line_dedup_query(spark, tmp_path):
    from gridtally.llm.queries import QUERIES

    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = {i: prose(rng, 80) for i in range(30)} | {40: passage + "\n" + prose(rng, 20), 41: prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 15), 42: passage, 43: None, 44: ""}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert set(got) == set(rows)  # none is dropped
    gone = words_of_earlier_runs(rows, LEAST_WORDS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {i: r.n_deleted for i, r in got.items()} == {i: len(g) for i, g in gone.items()}
    assert gone[42] and all(r.text_sha256 == sha(rows[i]) for i, r in got.items() if not gone[i] and i != 43)
    assert got[42].text_sha256 == sha("") and got[43].text_sha256 is None
    a = rows[41].split("\n")
    assert got[41].text_sha256 == sha(a[0] + "\n" + a[2])


def test_line_dedup_with_common_words(spark):
    """Common short words stand everywhere, so many places of a passage stand first in unrelated documents."""
    rng = random.Random(10)
    few = ["the", "of", "and", "to", "in", "a"]
    mixed = lambda n: " ".join(rng.choice(few) if rng.random() < 0.6 else rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    rows = {i: mixed(200) for i in range(100)}
    for i in range(40):  # passages of 51 words between words of their own, and runs of one word
        passage = mixed(51)
        for j in (200 + i, 300 + i, 400 + i):
            rows[j] = prose(rng, rng.randint(3, 30)) + " " + passage + " " + prose(rng, rng.randint(3, 30))
    rows |= {500: "la " * 300, 501: prose(rng, 5) + " la" * 200 + " " + prose(rng, 5), 502: rows[7] + " " + rows[7], 503: "lo li " * 150}
    got = {r.doc_id: r.text for r in drop_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), drop_emptied=False).collect()}
    gone = words_of_earlier_runs(rows, LEAST_WORDS)
    lost = {i: len(t.split()) - len(got[i].split()) for i, t in rows.items()}
    assert lost == {i: len(g) for i, g in gone.items()}
    assert min(lost[i] for i in range(300, 340)) >= 51 and got[502] == ""


def test_line_dedup_prints_of_a_few_words_over_and_over():
    for word, n in (("lo ", 1), ("lo li ", 2), ("lo li la ", 3)):
        assert len(Prints([word * (5000 // n)]).fingerprints()) <= 2 * 5000 / WINDOW + 5


def test_line_dedup_empty(spark):
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


def test_fingerprints(spark):
    rng = random.Random(8)
    rows = [(i * 7, prose(rng, rng.randint(1, 40))) for i in range(50)]
    rows += [(1000, "Straße ﬁn  é"), (1001, "STRASSE fin É"), (1002, None), (1003, ""), (1004, "x" * 50_000), (1005, "Straße ﬁn  é")]
    got = {r.doc_id: r for r in fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == float(canon(t) == canon(edited)) and got[i].near_next == float(canon(t) == canon(nxt))
    assert len({r.fingerprint for r in got.values()}) == len({canon(t) for _, t in rows})
    assert got[1000].fingerprint == got[1001].fingerprint and got[1002].fingerprint == got[1003].fingerprint
    assert exact_copies(docs(spark, rows)).agg(F.sum("copies")).first()[0] == len(rows)


def test_fingerprints_of_few_rows(spark):
    one = fingerprints(docs(spark, [(5, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert fingerprints(docs(spark, [])).count() == 0
    assert fingerprints(docs(spark, [(None, "a"), (None, "b"), (1, "c")])).count() == 3


def test_ranges_of_next_documents(spark, monkeypatch):
    """Guards carry the next document over the borders of ranges."""
    from gridtally.llm import fingerprints as module

    monkeypatch.setattr(module, "PER_RANGE", 7)
    rows = [(i * i, f"t{i}") for i in range(100)]
    got = {r.doc_id: r.next_text for r in module.with_next(docs(spark, rows)).collect()}
    assert got == {i * i: f"t{(i - 1) % 100}" for i in range(100)}


def test_fingerprints_plan_in_a_new_session():
    """Several ranges as the first query of a session: the optimizer failed there with "key not found"."""
    import os
    import subprocess
    import sys
    import tempfile

    code = """
import sys
from gridtally.session import session
from gridtally.llm import fingerprints
fingerprints.PER_RANGE = 250
s = session("local[2]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": sys.argv[1]})
rows = fingerprints.with_next(s.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "next_text").collect()
print("rows", len(rows))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code, tempfile.mkdtemp(prefix="spark-")], cwd=root, capture_output=True, text=True, timeout=300)
    assert "rows 1000" in done.stdout, done.stderr[-2000:]
