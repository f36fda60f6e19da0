"""Operators 1 and 3 against the tokenizers library."""

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

from gridtally.llm.bpe import encode_documents, word_bpe  # noqa: E402
from gridtally.llm.texts import vocabulary  # noqa: E402
from gridtally.llm.token_counts import FREE, PieceMarks, count_tokens, outer_step  # noqa: E402

LETTERS = "aabcdesttrvmlll'''  \n\t.!?<|>éÉßΣσİ123٣Ⅷ中文の  \x1c\x85​́é"


def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    out += ["<|endoftext|>", "a<|endoftext|>b", " <|startoftext|> x", "<|ENDOFTEXT|>", "aaaaaaaaaaa", "", "   ", "a" * 3000, "it's we'll they've I'd x'rex 'S don't' 're"]
    return out + ["a" + chr(c) + "B" for c in range(1, 0x3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_tokens string")


def test_ids_and_decoded_text(spark):
    tool = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tool.no_truncation()
    tool.no_padding()
    rows = texts() + [None]
    got = {r.doc_id: r for r in encode_documents(frame(spark, rows), vocabulary("word_bpe_49k.json")).collect()}
    assert len(got) == len(rows)
    for i, e in enumerate(tool.encode_batch([t or "" for t in rows], add_special_tokens=False)):
        r = got[i]
        assert list(r.token_ids) == e.ids and r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e.ids)).hexdigest()
        assert r.decoded == tool.decode(e.ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert word_bpe(vocabulary("word_bpe_49k.json")).decode(list(got[5].token_ids)) == got[5].decoded


def test_ranks_only_grow():
    """A merge's parts are made by earlier merges, so ascending ranks are the library's order."""
    bpe = word_bpe(vocabulary("word_bpe_49k.json"))
    made = {m: r for r, m in enumerate(bpe.made.tolist())}
    assert len(made) == len(bpe.made)
    assert all(made.get(a, -1) < r and made.get(b, -1) < r for r, (a, b) in enumerate(zip(bpe.left.tolist(), bpe.right.tolist())))


def test_token_counts(spark):
    tool = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tool.no_truncation()
    tool.no_padding()
    rows = texts() + [None]
    got = {r.doc_id: r for r in count_tokens(frame(spark, rows), vocabulary("byte_bpe_50k.json")).collect()}
    for i, e in enumerate(tool.encode_batch([t or "" for t in rows], add_special_tokens=False)):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(e.ids), len((rows[i] or "").encode()), len(e.ids) > 512)


def twins(a, b, k):
    """A Thue-Morse string of 2 ** k letters and its complement."""
    for _ in range(k):
        a, b = a + b, b + a
    return [a, b]


def test_token_counts_of_long_pieces():
    """Pieces of many chunks, periodic and random ones, and strings that collide under polynomial hashes."""
    from gridtally.llm.token_counts import PART, TokenCounter

    tool = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tool.no_truncation()
    rng = random.Random(3)
    rows = [*twins("t", "h", 10), *twins("e", "r", 11), *twins("e", "r", 12), "a" * 20_000, "ab" * 5000, "=" * 5001 + " x", "-" * 9000, " " * 9000 + "x", "\n" * 5000, "中文" * 3000]
    rows += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("etaoin", "abcdefghijklmnopqrstuvwxyz") for n in (PART - 1, PART, PART + 1, 8000)]
    counter = TokenCounter(vocabulary("byte_bpe_50k.json"))
    expected = [len(e.ids) for e in tool.encode_batch(rows, add_special_tokens=False)]
    assert counter.count(rows).tolist() == expected
    assert [int(counter.count([t])[0]) for t in rows] == expected
    assert max(map(len, counter.known)) <= 64


def test_chunk_maps_from_wrong_guesses(monkeypatch):
    """Where the guessed entry states are wrong, chunks run again."""
    from gridtally.llm import token_counts

    monkeypatch.setattr(token_counts, "PART", 5)
    monkeypatch.setattr(token_counts, "OVERLAP", 1)
    tool = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(4)
    rows = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in range(1, 200, 7)]
    counter = token_counts.TokenCounter(vocabulary("byte_bpe_50k.json"))
    assert counter.count(rows).tolist() == [len(e.ids) for e in tool.encode_batch(rows, add_special_tokens=False)]


def test_repeated_rows(spark):
    rows = ["it's a test"] * 3
    frame_ = spark.createDataFrame([(1, t, 5) for t in rows], "doc_id long, text string, n_bytes int")
    assert {tuple(r) for r in count_tokens(frame_, vocabulary("byte_bpe_50k.json")).collect()} == {(1, 11, 4, False)}
    assert encode_documents(frame_, vocabulary("word_bpe_49k.json")).count() == 3


def test_monoid_composes_single_steps():
    """Products of state maps equal steps one by one."""
    marks, rng = PieceMarks(), random.Random(2)
    for _ in range(50):
        classes = [rng.randrange(12) for _ in range(20)]
        state, whole = FREE, 0
        for c in classes:
            state = outer_step(state, c)[0]
            whole = marks.product[whole, marks.of_class[c]]
        assert marks.after[whole, FREE] == state


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0
    assert count_tokens(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_word_bpe_normalises_as_the_library():
    """Every combining mark behind and before marks of other classes, and every composition."""
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    from gridtally.llm.bpe import composed

    nfc = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))).normalizer[0]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in every if unicodedata.combining(c)]
    texts = [f"q{a}{c}{b}" for c in marks for a, b in (("\u0315", ""), ("", "\u0334"), ("\u0345", "\u0327"), ("\u0301", "\u0301"))]
    texts += [unicodedata.normalize("NFD", c) for c in every] + [c + "\u0301" for c in every]
    assert [t for t in texts if nfc.normalize_str(t) != composed(t)] == []
