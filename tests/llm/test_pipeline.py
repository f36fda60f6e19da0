"""The pipeline's stages, one after the other, against brute force on a small corpus."""

import hashlib
import random
from collections import Counter

import pytest

tokenizers = pytest.importorskip("tokenizers")

from gridtally.llm import toxicity  # noqa: E402
from gridtally.llm.line_dedup import LEAST_WORDS  # noqa: E402
from gridtally.llm.texts import vocabulary  # noqa: E402
from tests.llm.test_dedup import classes, prose, words_of_earlier_runs  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic, repeated, nearly repeated and empty texts, of which most are labelled."""
    rng = random.Random(31)
    path, rows, labels = tmp_path_factory.mktemp("corpus"), [], []
    passage = prose(rng, 60)
    for i in range(420):
        words = prose(rng, rng.randint(30, 60)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilething", "vilehead", "grubby"]))
        rows.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, int(bad)))
    for i in range(6):  # a passage in the midst of other words
        rows.append((500 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "s0"))
    clean = rows[1][1].split()
    for i in range(5):  # short texts that differ in a word at the end: too short for the line stage
        rows.append((600 + i, " ".join(clean[:20]) + f" end{i}", "s1"))
    rows += [(700, rows[2][1], "s2"), (701, "", "s1"), (702, None, None), (703, "x y", None)]
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder, tmp_path):
    import corpus_pipeline

    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held, kinds = {}, docs.schema

    def apply(name, df):
        stages[name](spark, df, folder).write.parquet(f"{tmp_path}/{name}")
        held[name] = spark.read.parquet(f"{tmp_path}/{name}")
        return held[name]

    # toxic documents go, and only they
    start, kept = texts(docs), texts(apply("toxicity", docs))
    scored = toxicity.score_documents(docs, toxicity.trained(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert set(kept) == {r.doc_id for r in scored.collect() if not r.predicted}
    bad = {i for i, t in start.items() if t and "vilething" in t or t and "vilehead" in t or t and "grubby" in t}
    assert len(bad - set(kept)) >= 0.9 * len(bad) and len(set(start) - bad - set(kept)) <= 2
    assert all(start[i] == t for i, t in kept.items())

    # words in runs that stand earlier go; a document that loses all goes
    lines = texts(apply("line_dedup", held["toxicity"]))
    gone = words_of_earlier_runs(kept, LEAST_WORDS)
    left = {i: [w for k, w in enumerate((t or "").split()) if k not in gone[i]] for i, t in kept.items()}
    assert set(lines) == {i for i in kept if left[i] or not gone[i]}
    assert {i: (t or "").split() for i, t in lines.items()} == {i: left[i] for i in lines}
    assert {r.doc_id: r.n_chars for r in held["line_dedup"].collect()} == {i: None if t is None else len(t) for i, t in lines.items()}

    # one document of each class of near copies stays, the one of the least id
    near = texts(apply("near_dedup", held["line_dedup"]))
    by = classes(list(lines.items()), 5)
    assert near == {i: lines[i] for i, (_, component, stays) in by.items() if stays}
    assert len(lines) - len(near) >= 3

    # documents come as often as the mix takes them, none more than twice; sources come near their targets
    mixed = apply("mixing", held["near_dedup"])
    assert mixed.schema.names == kinds.names
    times, source = Counter(r.doc_id for r in mixed.collect()), {r.doc_id: r.source for r in docs.collect()}
    assert set(times) <= {i for i, t in near.items() if (t or "").split()} and max(times.values()) <= 2
    size = lambda i: len((near[i] or "").split())
    own, taken = Counter(), Counter()
    for i in near:
        own[source[i]] += size(i)
        taken[source[i]] += size(i) * times[i]
    weights, target, open_ = {"s0": 3, "s1": 1, "s2": 2, None: 3}, {}, {"s0", "s1", "s2", None}
    rest = 1.5 * sum(own.values())
    while full := {s for s in open_ if rest * weights[s] / sum(weights[x] for x in open_) >= 2 * own[s]}:
        for s in full:
            target[s] = 2 * own[s]
        rest -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)

    # every copy is encoded as the library does
    tool = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tool.no_truncation()
    tool.no_padding()
    out = stages["encoding"](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in out) == times
    for r in out:
        e = tool.encode(near[r.doc_id], add_special_tokens=False)
        assert list(r.token_ids) == e.ids and r.n_tokens == len(e.ids)
        assert r.decoded_sha256 == hashlib.sha256(tool.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()

    again = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert again == Counter((r.doc_id, r.ids_sha256) for r in out)


def test_stages_of_an_empty_table(spark, folder):
    import corpus_pipeline

    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
