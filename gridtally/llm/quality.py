"""Operator 7: quality rules on repeats and on a public tokenizer's fertility.

Each distinct word of a slice is encoded once with a vocabulary that falls back to bytes. From the
tokens come a document's characters per token, its share of byte tokens and its evenness: the entropy of its
tokens over the logarithm of their number. Each must lie in the fixed, wide band of the document's
script, the one with most of its letters, and in the band of its language (the column lang, or the
script where that is null or absent). A language's bands come from all of its documents that pass the base rules:
from the median so many times the way to the quartile on that side (REACH; further in languages of
few documents, and LEAST at least). Evenness falls with a text's length, so its band lies about the
line of evenness over the logarithm of the number of tokens, fitted by least squares on exact sums, for all lengths
from the first to the last hundredth and a little BEYOND. Prose stays inside, whatever the
vocabulary knows of its language; strings of symbols, encoded data and endless repeats do not. A row's verdict so
depends on the whole table; its base columns depend on its text alone.

Base rules count words, their code points, symbols, repeated lines, and words in three-word windows
that occur twice or more. Only the measures are shuffled, never texts.

Defined cases: null and empty texts have no words and fail; repeated rows give repeated results;
extra columns are not read; an empty table gives no rows. A document without letters has script 'none'.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.session import checkpointed
from gridtally.llm.texts import FlatWords, members, mix, releasing, text_slices

SLICE_CHARS, CACHED_WORDS = 2_000_000, 250_000
FEW_DOCUMENTS, BROADCAST_GROUPS = 20.0, 100_000
#: For each measure: times the way from the median to the quartile below and above, and the least width of the band on a side.
BEYOND = 0.5
REACH = {"chars_per_token": (8.0, 8.0, 0.02), "byte_share": (8.0, 8.0, 0.02), "bent": (5.0, 10.0, 0.01)}
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a script's documents keep: characters per token, at most this share of byte tokens, token evenness."""

    chars_low: float
    chars_high: float
    bytes_high: float
    even_low: float


BANDS = {
    "latin": Band(1.2, 8.0, 0.30, 0.45),
    "greek": Band(0.6, 6.0, 0.60, 0.40),
    "cyrillic": Band(0.8, 8.0, 0.50, 0.40),
    "arabic": Band(0.4, 6.0, 0.80, 0.35),
    "cjk": Band(0.25, 4.0, 0.95, 0.35),
    "other": Band(0.2, 8.0, 1.00, 0.30),
    "none": Band(1.0, 8.0, 0.30, 0.45),
}
SCRIPTS = list(BANDS)


def script_table() -> np.ndarray:
    """Each code point's script as a number in SCRIPTS."""
    table = np.full(0x110000, SCRIPTS.index("none"), np.uint8)
    table[members("L")] = SCRIPTS.index("other")
    letters = table == SCRIPTS.index("other")
    for name, spans in (
        ("latin", [(0x41, 0x250), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xFF21, 0xFF5B)]),
        ("greek", [(0x370, 0x400), (0x1F00, 0x2000)]),
        ("cyrillic", [(0x400, 0x530), (0x1C80, 0x1C90), (0x2DE0, 0x2E00), (0xA640, 0xA6A0)]),
        ("arabic", [(0x600, 0x700), (0x750, 0x780), (0x8A0, 0x900), (0xFB50, 0xFE00), (0xFE70, 0xFF00)]),
        ("cjk", [(0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7B0), (0xF900, 0xFB00), (0x20000, 0x32000)]),
    ):
        for a, b in spans:
            table[a:b][letters[a:b]] = SCRIPTS.index(name)
    return table


class Measures:
    """The vocabulary, the tokens of words met, and a text's measures."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.scripts = script_table()
        self.tokens: dict[bytes, np.ndarray] = {}

    def word_tokens(self, words: list[bytes]) -> list[np.ndarray]:
        if new := [w for w in words if w not in self.tokens]:
            if len(self.tokens) + len(new) > CACHED_WORDS:
                self.tokens.clear()
                new = words
            ids = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
            self.tokens.update((w, np.array(x, np.int32)) for w, x in zip(new, ids))
        return [self.tokens[w] for w in words]

    def measure(self, texts: list[str]) -> dict[str, np.ndarray]:
        n = len(texts)
        words = FlatWords(texts)
        h, owner, counts = words.hashes(), words.text_of, words.counts
        out = {"n_words": counts.astype(np.int64)}
        of_byte = np.repeat(np.arange(n), np.diff(words.text_ends, prepend=0))
        first_bytes = ~words.space & ((words.bytes & 0xC0) != 0x80)
        out["word_chars"] = np.bincount(of_byte[first_bytes], minlength=n)
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        out["n_symbols"] = np.bincount(of_byte[symbol[words.bytes]], minlength=n)
        out["n_dup_lines"] = np.array([_repeated_lines(t) for t in texts], np.int64)
        out["n_repeat_words"] = self.repeated_words(h, owner, n)

        _, sample, which = np.unique(h, return_index=True, return_inverse=True)
        raw = words.bytes.tobytes()
        distinct = self.word_tokens([raw[a:b] for a, b in zip(words.starts[sample].tolist(), words.ends[sample].tolist())])
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        flat = np.concatenate(distinct) if distinct else np.zeros(0, np.int32)
        per_word = size[which]
        n_tokens = np.bincount(owner, per_word, minlength=n)
        start = np.cumsum(size) - size
        at = np.repeat(start[which] - (np.cumsum(per_word) - per_word), per_word) + np.arange(int(per_word.sum()))
        token, token_owner = flat[at], np.repeat(owner, per_word)
        n_bytes = np.bincount(token_owner[self.is_byte[token]], minlength=n)
        key, times = np.unique(token_owner * 65536 + token, return_counts=True)
        of = key // 65536
        share = times / np.maximum(n_tokens[of], 1)
        out["token_entropy"] = np.bincount(of, -share * np.log2(share), minlength=n)
        out["chars_per_token"] = out["word_chars"] / np.maximum(n_tokens, 1)
        out["byte_share"] = n_bytes / np.maximum(n_tokens, 1)
        out["n_tokens"] = n_tokens.astype(np.int64)
        out["evenness"] = evenness = out["token_entropy"] / np.log2(np.maximum(n_tokens, 2))

        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        of_point = np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n))
        table = np.bincount(of_point * len(SCRIPTS) + self.scripts[points], minlength=n * len(SCRIPTS)).reshape(n, -1)
        none = SCRIPTS.index("none")
        script = np.where(table[:, :none].sum(axis=1) > 0, table[:, :none].argmax(axis=1), none)
        out["script"] = np.array(SCRIPTS)[script]
        low, high, most, even = (np.array([getattr(BANDS[s], k) for s in SCRIPTS])[script] for k in ("chars_low", "chars_high", "bytes_high", "even_low"))
        # a limit of the vocabulary's evenness says little about a few tokens
        banded = (out["chars_per_token"] >= low) & (out["chars_per_token"] <= high) & (out["byte_share"] <= most) & (evenness >= even)
        out["base_failed"] = (counts < 50) | (100 * out["n_repeat_words"] > 50 * counts)
        out["kept"] = ~out["base_failed"] & banded
        return out

    @staticmethod
    def repeated_words(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Words of each text that stand in a three-word window found twice or more in it."""
        if len(h) < 3:
            return np.zeros(n, np.int64)
        base = np.uint64(0xD6E8FEB86659FD93)
        g = (h[:-2] * base + h[1:-1]) * base + h[2:]
        inside = owner[2:] == owner[:-2]
        key = mix(g + owner[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, times = np.unique(key[inside], return_inverse=True, return_counts=True)
        again = np.zeros(len(h), bool)
        at = np.flatnonzero(inside)[times[which] > 1]
        for k in range(3):
            again[at + k] = True
        return np.bincount(owner[again], minlength=n)


def _repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return again


@lru_cache(maxsize=2)
def measures(path: str) -> Measures:
    return Measures(path)


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "script": "string", "chars_per_token": "double", "byte_share": "double", "token_entropy": "double", "n_tokens": "long", "evenness": "double"}

ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def quality(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and COLUMNS for each row."""

    def run(batches):
        tool = measures(path)
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                found = tool.measure(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(found[c], ARROW[k]) for c, k in COLUMNS.items())], ["doc_id", "lang", *COLUMNS])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, " + ", ".join(f"{c} {k}" for c, k in COLUMNS.items())
    measured = checkpointed(docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(releasing(run, lambda: measures(path).tokens.clear()), kinds).withColumn("group", F.coalesce("lang", "script")))
    log = F.log2(F.greatest("n_tokens", F.lit(2)))
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    x, y = log, F.col("evenness")
    sums = measured.filter("not base_failed").groupBy("group").agg(F.count("*").cast("double").alias("n"), exact(x).alias("x"), exact(y).alias("y"), exact(x * x).alias("xx"), exact(x * y).alias("xy"), F.percentile(F.round(x, 2), [0.01, 0.99]).alias("lengths"))
    spread = F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(spread > 1e-6, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / spread).otherwise(0.0)
    lines = sums.withColumn("slope", slope).select("group", "slope", "lengths", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("height"))
    # how far a document's evenness lies from its language's line, which says nothing of lengths that few documents have
    usual = log.between(F.col("lengths")[0] - BEYOND, F.col("lengths")[1] + BEYOND)
    bent = measured.join(_few(lines), "group", "left").withColumn("bent", F.when(usual, F.col("evenness") - F.col("height") - F.col("slope") * log)).drop("height", "slope", "lengths")
    # few distinct values, so exact percentiles stay small
    quartiles = [F.percentile(F.round(c, 3), [0.25, 0.5, 0.75]).alias(f"q_{c}") for c in REACH]
    found = bent.filter("not base_failed").groupBy("group").agg(F.count("*").alias("n"), *quartiles)
    bands = []
    for c, (below, above, least) in REACH.items():
        q, far = F.col(f"q_{c}"), 1 + FEW_DOCUMENTS / F.col("n")
        bands += [(q[1] - F.greatest(F.lit(least), below * far * (q[1] - q[0]))).alias(f"low_{c}"), (q[1] + F.greatest(F.lit(least), above * far * (q[2] - q[1]))).alias(f"high_{c}")]
    joined = bent.join(_few(found.select("group", *bands)), "group", "left")
    inside = F.lit(True)
    for c in REACH:
        inside = inside & F.coalesce(F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}")), F.lit(True))
    return joined.withColumn("kept", F.col("kept") & inside).select("doc_id", *COLUMNS)


def _few(groups: DataFrame) -> DataFrame:
    """groups, to be broadcast if they are few."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def oracle() -> str:
    """DuckDB SQL for the base columns and their rule."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, regexp_extract_all(t, '{word}') AS w FROM d),
    g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    a AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
    p AS (SELECT r, count(DISTINCT i + k) AS n FROM a, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
    l AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY r)
    SELECT d.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(w.w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w.w) AS base_failed
    FROM d JOIN w USING (r) LEFT JOIN p USING (r) LEFT JOIN l USING (r)"""
