"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public vocabulary file's path; TOKENIZER_DIR names another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters and numbers that Unicode 16 added, for unicodedata of an earlier version.
ADDED = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}


def members(group: str) -> list[int]:
    """The code points of a general category's first letter, ascending."""
    known = {c for c in range(0x110000) if unicodedata.category(chr(c))[0] == group}
    return sorted(known.union(*(range(a, b + 1) for a, b in ADDED.get(group, []))))


@lru_cache(maxsize=8)
def char_class(group: str) -> str:
    """The inside of a character class: of a general category's first letter, or of white space for ''."""
    points = members(group) if group else WHITE_SPACE
    out, first = [], 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i] != points[i - 1] + 1:
            out.append(f"{re.escape(chr(points[first]))}-{re.escape(chr(points[i - 1]))}")
            first = i
    return "".join(out)


def text_slices(batch: pa.RecordBatch, column: str, max_chars: int):
    """Slices of an Arrow batch with about max_chars bytes of text each (one row at least), and their texts; nulls come as ''.

    Only one slice's texts are Python strings at a time.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    cuts, size = [0], 0
    for i, n in enumerate(sizes):
        if i > cuts[-1] and size + n > max_chars:
            cuts.append(i)
            size = 0
        size += n
    for a, b in zip(cuts, [*cuts[1:], len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a), [x or "" for x in texts.slice(a, b - a).to_pylist()]


def releasing(run, *forget):
    """A function of a task's batches that, when they end, calls forget and gives free memory back to the system.

    Workers live on from task to task and from stage to stage; what one operator has cached is of no use to the next.
    """

    def task(batches):
        yield from run(batches)
        for f in forget:
            f()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return task


class FlatWords:
    """The words of some texts as flat arrays: a 64-bit hash of each word and the text that it stands in.

    Words are maximal runs of bytes other than space and 9 to 13 in UTF-8, which equals the
    same rule on code points. Hashes are XXH3 values of a word's bytes, so equal words of one
    process or another have equal hashes, and no family of words is known to collide by its form.
    """

    _SPACE = np.zeros(256, bool)
    _SPACE[[32, 9, 10, 11, 12, 13]] = True
    _FOLD = np.arange(256, dtype=np.uint8)
    _FOLD[65:91] += 32

    def __init__(self, texts: list[str], fold: bool = False):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        self.bytes = self._FOLD[raw] if fold else raw
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        self.text_ends = np.cumsum(lengths)
        space = self._SPACE[self.bytes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.text_of = np.searchsorted(self.text_ends, self.starts, side="right")
        self.counts = np.bincount(self.text_of, minlength=len(texts))
        self.space = space

    def hashes(self) -> np.ndarray:
        # bytes.split() cuts at space and 9 to 13, as above
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, self.bytes.tobytes().split())), np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fresh(columns: list[str], name: str) -> str:
    """A column name like name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text) -> F.Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
