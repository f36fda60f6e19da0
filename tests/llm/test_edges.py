"""Every operator on nulls, empty and very long texts, repeated rows, empty tables, and further columns whose names clash."""

import pytest

from gridtally.llm import secrets, toxicity
from gridtally.llm.bpe import encode_documents
from gridtally.llm.fingerprints import fingerprints
from gridtally.llm.html_text import extract_pages
from gridtally.llm.line_dedup import deletions, drop_repeats
from gridtally.llm.mixing import draw, mix_documents
from gridtally.llm.near_dedup import near_classes
from gridtally.llm.quality import quality
from gridtally.llm.texts import vocabulary
from gridtally.llm.token_counts import count_tokens

CLASHES = "n_tokens n_bytes size found kinds index print mark pos of at keys key range copies target words rep hub root node group script score held_out component_id kept guard canon _doc _found _size _id _copies ids".split()
TEXTS = [(1, "a b c"), (1, "a b c"), (2, None), (None, "x y"), (None, None), (3, ""), (4, "word " * 100_000), (5, " \n "), (6, "a b c"), (7, "token=abcdef01"), (8, "é" * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i in (2, 6) else "s", *["z"] * len(CLASHES)) for i, t in TEXTS], schema).cache()


def scored(df):
    labels = df.sparkSession.createDataFrame([(1, 0), (4, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    return toxicity.score_documents(df, toxicity.trained(df, labels))


OPERATORS = {
    "bpe": lambda df: encode_documents(df, vocabulary("word_bpe_49k.json")),
    "near": near_classes,
    "tokens": lambda df: count_tokens(df, vocabulary("byte_bpe_50k.json")),
    "lines": deletions,
    "kept lines": lambda df: drop_repeats(df, drop_emptied=False),
    "secrets": lambda df: secrets.secret_digest(secrets.find_secrets(df)),
    "mixing": mix_documents,
    "quality": lambda df: quality(df, vocabulary("piece_bpe_32k.model")),
    "fingerprints": fingerprints,
    "toxicity": scored,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_a_document(docs, name):
    out = OPERATORS[name](docs).collect()
    assert len(out) == len(TEXTS)
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in TEXTS)
    same = [tuple(r) for r in out if r.doc_id == 1]
    if name not in ("mixing", "fingerprints"):  # copies are dealt one by one; the next document differs
        assert same[0] == same[1]
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_results_of_odd_texts(docs):
    of = lambda name, i: next(r for r in OPERATORS[name](docs).collect() if r.doc_id == i)
    assert of("bpe", 2).n_tokens == of("tokens", 2).n_tokens == 0 and of("tokens", 4).n_tokens > 100_000 and of("tokens", 8).n_bytes == 60_000
    assert not of("quality", 2).kept and of("near", 3).n_shingles == 0 and of("near", 6).component_id == 1
    assert of("mixing", 2).size == 0 and of("mixing", 2).taken == 0
    assert of("lines", 2).text_sha256 is None and of("secrets", 7).n_assign == 1 and of("fingerprints", 2).n_chars == 0


def test_columns_that_clash_stay(docs):
    assert draw(docs).columns == docs.columns and drop_repeats(docs).columns == docs.columns
    assert {r.size for r in draw(docs).collect()} == {"z"}


def test_pages(spark):
    rows = [(1, "u", "<p>a</p>", "z"), (1, "u", "<p>a</p>", "z"), (None, None, None, None), (2, "u", "<p>" + "long text " * 100_000 + "</p>", "z"), (3, "u", "<div>" * 100_000 + "x", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    out = extract_pages(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == [("1", 1), ("1", 1), ("2", 999_999), ("3", 1), ("None", 0)]
    assert extract_pages(df.limit(0)).count() == 0
