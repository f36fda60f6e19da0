"""Operator 4: deletion of repeated runs of words by winnowing.

A print is a hash of SHINGLE consecutive words, whatever lines they stand in; of every WINDOW neighbouring
prints the least is a fingerprint. Places are taken for copies if 96 bits of hashes of their words are equal (the
print and a mark from another polynomial), and words beside them by 64 bits. Any run of SHINGLE + WINDOW - 1 words (49) that stands at two
places has a fingerprint in common, and a common fingerprint is itself a repeat of SHINGLE words.

Each fingerprint's first place in the corpus (by doc_id, then position) is found by one aggregation, its second one by
another over the later places; every later place is joined with these two, never with all others, and its SHINGLE words
are deleted. The second place tells of copies of a document that holds a passage from elsewhere.
Fingerprints of one run lie WINDOW words apart at most, so with WINDOW <= SHINGLE their words adjoin; at
the ends of such a chain WINDOW - 1 words of the first document on either side travel to the later
one, and the run is extended word by word. Beyond them another fingerprint would stand. A first place
lies before every place that is deleted for it, so one copy of each run stays.

Defined cases: null and empty texts stay as they are; rows that share a doc_id count as one document
and don't delete each other's text; a null doc_id comes first of all; a document that loses all its
words goes when drop_emptied is set; extra columns stay as they are. Empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridtally.session import work_folder
from gridtally.llm.texts import FlatWords, fresh, mix, releasing, text_slices

SHINGLE, WINDOW, LEAST_WORDS = 25, 25, 25
SLICE_CHARS = 1_000_000
FIRST = -(2**63)
BROADCAST_IDS = 1_000_000
_BASE, _MARK_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class Prints:
    """The words of some texts, the hash of the SHINGLE words from each on, and where each text's words begin."""

    def __init__(self, texts: list[str]):
        self.words = FlatWords(texts)
        self.hash = self.words.hashes()
        self.first = np.concatenate(([0], np.cumsum(self.words.counts)))
        n = max(0, len(self.hash) - SHINGLE + 1)
        self.print = mix(self.polynomial(_BASE, n, lambda i: self.hash[i : i + n]))

    @staticmethod
    def polynomial(base: int, n: int, words) -> np.ndarray:
        """Of n shingles, words(i) being the hashes of their words i."""
        out, power = np.zeros(n, np.uint64), 1
        for i in range(SHINGLE if n else 0):
            out += words(i) * np.uint64(power)
            power = power * base % 2**64
        return out

    def marks(self, at: np.ndarray) -> np.ndarray:
        """32 more bits for the prints at some places."""
        whole = self.polynomial(_MARK_BASE, len(at), lambda i: self.hash[at + i])
        return (mix(whole, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def whole(self, span: int) -> np.ndarray:
        """Whether the span words from each on, as far as there are so many, are of one text."""
        owner = self.words.text_of
        return owner[: max(len(owner) - span + 1, 0)] == owner[span - 1 :]

    def fingerprints(self) -> np.ndarray:
        """Positions of the least print in each window; all of a text with fewer prints. Of equal ones in a row (a few words over and over) the first two, and the first and last of every WINDOW places stay: no gap is wider than WINDOW, so their words still adjoin."""
        n = len(self.print)
        if not n:
            return np.zeros(0, np.int64)
        chosen = np.zeros(n, bool)
        if n >= WINDOW:
            views = np.lib.stride_tricks.sliding_window_view(self.print, WINDOW)
            least = views.argmin(axis=1) + np.arange(n - WINDOW + 1)
            chosen[least[self.whole(SHINGLE + WINDOW - 1)]] = True
        short = np.diff(self.first) < SHINGLE + WINDOW - 1
        chosen |= short[self.words.text_of[:n]]
        chosen &= self.whole(SHINGLE)
        at = np.flatnonzero(chosen)
        if not len(at):
            return at
        print_, owner, k = self.print[at], self.words.text_of[at], np.arange(len(at))
        again = np.concatenate(([False], (print_[1:] == print_[:-1]) & (owner[1:] == owner[:-1]) & (at[1:] - at[:-1] <= WINDOW)))
        start = np.maximum.accumulate(np.where(again, 0, k))
        part = (at - at[start]) // WINDOW
        opens = ~again | np.concatenate(([True], part[1:] != part[:-1]))
        return at[opens | np.append(opens[1:], True) | (k - start == 1)]


def _ids(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), "text", *columns)


def _positions(docs: DataFrame) -> DataFrame:
    """(doc, print, mark, pos): the fingerprints of each document."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                units = Prints(texts)
                at = units.fingerprints()
                owner = units.words.text_of[at]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(units.print[at].view(np.int64)), pa.array(units.marks(at)), pa.array((at - units.first[owner]).astype(np.int32))], ["doc", "print", "mark", "pos"])

    return _ids(docs).mapInArrow(releasing(run), "doc long, print long, mark int, pos int")


def _sides(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(of, at, print, mark, before, after): hashes of the words on either side of the asked (of, at, print, mark); before runs backward."""
    wanted = asked.groupBy("of").agg(F.collect_set(F.struct("at", "print", "mark")).alias("asked"))
    ids = asked.select(F.col("of").alias("doc")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                units = Prints(texts)
                words = units.hash.view(np.int64)
                out = []
                for i, (of, found) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    lo, hi = int(units.first[i]), int(units.first[i + 1])
                    for x in found:
                        at = lo + x["at"]
                        if at + SHINGLE <= hi and int(units.print[at : at + 1].view(np.int64)[0]) == x["print"]:
                            end = at + SHINGLE
                            out.append((of, x["at"], x["print"], x["mark"], words[max(lo, at - WINDOW + 1) : at][::-1].tolist(), words[end : min(hi, end + WINDOW - 1)].tolist()))
                columns = zip(*out) if out else ((),) * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    kinds = {"of": pa.int64(), "at": pa.int32(), "print": pa.int64(), "mark": pa.int32(), "before": pa.list_(pa.int64()), "after": pa.list_(pa.int64())}
    held = _ids(docs).join(ids, "doc", "left_semi").join(wanted, F.col("doc") == F.col("of")).select("doc", "text", "asked")
    return held.mapInArrow(releasing(run), "of long, at int, print long, mark int, before array<long>, after array<long>")


def matches(docs: DataFrame) -> DataFrame:
    """(doc, found): for each later document its fingerprints that stand earlier, as structs (pos, print, own, before, after).

    own is the earlier place where that is in the same document; before and after are the earlier document's words
    beyond the ends of a chain.

    A run that goes on where its fingerprints stand first and second in other documents is followed up to WINDOW - 1 words less.
    """
    folder = work_folder(docs.sparkSession)
    _positions(docs).write.parquet(f"{folder}/prints")
    prints = docs.sparkSession.read.parquet(f"{folder}/prints")
    first = prints.groupBy("print", "mark").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max(F.struct("doc", "pos")).alias("last"))
    first = first.filter("first <> last").select("print", "mark", F.col("first.doc").alias("of"), F.col("first.pos").alias("at"))
    behind = "doc > of or (doc = of and pos > at)"
    prints.join(first, ["print", "mark"]).filter(behind).distinct().write.parquet(f"{folder}/of_first")
    of_first = docs.sparkSession.read.parquet(f"{folder}/of_first")
    second = of_first.groupBy("print", "mark").agg(F.min(F.struct("doc", "pos")).alias("second")).select("print", "mark", F.col("second.doc").alias("of"), F.col("second.pos").alias("at"))
    of_second = of_first.drop("of", "at").join(second, ["print", "mark"]).filter(behind)
    later = of_first.unionByName(of_second)
    chain = Window.partitionBy("doc", "of", F.col("pos") - F.col("at")).orderBy("at")
    far = lambda other: F.coalesce(F.abs(other - F.col("at")) > SHINGLE, F.lit(True))
    later.select("*", far(F.lag("at").over(chain)).alias("opens"), far(F.lead("at").over(chain)).alias("closes")).write.parquet(f"{folder}/later")
    later = docs.sparkSession.read.parquet(f"{folder}/later")
    ends = later.filter("(opens or closes) and doc <> of")
    own = F.when(F.col("doc") == F.col("of"), F.col("at")).alias("own")
    none = F.lit(None).cast("array<long>")
    inner = later.filter("doc = of or not (opens or closes)").select("doc", "pos", "print", own, none.alias("before"), none.alias("after")).distinct()
    sides = _sides(docs, ends.select("of", "at", "print", "mark").distinct())
    outer = ends.join(sides, ["of", "at", "print", "mark"]).select("doc", "pos", "print", own, F.when(F.col("opens"), F.col("before")).alias("before"), F.when(F.col("closes"), F.col("after")).alias("after"))
    return inner.union(outer).groupBy("doc").agg(F.collect_list(F.struct("pos", "print", "own", "before", "after")).alias("found"))


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words at the start of both are equal."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _gone(words: np.ndarray, prints: np.ndarray, found: list) -> np.ndarray:
    """Which of a text's words (their hashes; prints are those of its whole shingles) lie in runs that stand earlier."""
    gone = np.zeros(len(words), bool)
    for x in found:
        a = x["pos"]
        b = a + SHINGLE
        if a >= len(prints) or int(prints[a]) != x["print"]:  # of another row of the same id
            continue
        own = x["own"]
        if own is not None:
            if int(prints[own]) != x["print"]:
                continue
            left, right = _alike(words[max(0, own - WINDOW + 1) : own][::-1], words[max(0, a - WINDOW + 1) : a][::-1]), _alike(words[own + SHINGLE : own + SHINGLE + WINDOW - 1], words[b : b + WINDOW - 1])
            a = max(a - left, own + 1)
        else:
            left = _alike(np.asarray(x["before"] or [], np.int64), words[max(0, a - WINDOW + 1) : a][::-1])
            right = _alike(np.asarray(x["after"] or [], np.int64), words[b : b + WINDOW - 1])
            a -= left
        gone[a : b + right] = True
    return gone


def drop_repeats(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """docs with later repeated runs deleted from text; all other columns as they are."""
    return _dropped(docs, drop_emptied).select(*docs.columns)


def _dropped(docs: DataFrame, drop_emptied: bool, counted: str | None = None) -> DataFrame:
    """docs without their repeats; with `counted`, a column of that name has the number of words that each lost."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, *([StructField(counted, LongType())] if counted else [])])
    key, hits = fresh(names, "_doc"), fresh(names, "_found")
    folder = work_folder(docs.sparkSession)
    matches(docs).select(F.col("doc").alias(key), F.col("found").alias(hits)).write.parquet(f"{folder}/found")
    found = docs.sparkSession.read.parquet(f"{folder}/found")
    own = lambda other: F.coalesce(docs["doc_id"].cast("long"), F.lit(FIRST)) == other[key]
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                out, kept, lost = _without(texts, part.column(len(names)).to_pylist(), part.column(at))
                columns = [part.column(i) for i in range(len(names))] + ([pa.array(lost, pa.int64())] if counted else [])
                columns[at] = pa.array(out, pa.string())
                new = pa.RecordBatch.from_arrays(columns, schema.names)
                yield new.filter(pa.array(kept)) if drop_emptied else new

    ids = found.select(key)
    if ids.count() > BROADCAST_IDS:
        return docs.join(found, own(found), "left").select(*names, hits).mapInArrow(releasing(run), schema)
    # only texts with something to delete are shuffled
    ids = F.broadcast(ids)
    hit = docs.join(ids, own(ids), "left_semi")
    changed = hit.join(found, F.coalesce(hit["doc_id"].cast("long"), F.lit(FIRST)) == found[key]).select(*names, hits).mapInArrow(releasing(run), schema)
    none = [F.lit(0).cast("long").alias(counted)] if counted else []
    return docs.join(ids, own(ids), "left_anti").select(*names, *none).union(changed)


def deletions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_deleted, text_sha256): the words that each document loses and the digest of what is left, null for a null text."""
    out = _dropped(docs.select("doc_id", "text"), drop_emptied=False, counted="n_deleted")
    return out.select("doc_id", "n_deleted", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _without(texts: list[str], found: list, column) -> tuple[list, list[bool], list[int]]:
    """The texts without their repeated runs, whether any word is left that was there, and the words that went."""
    out: list = column.to_pylist()
    kept, lost = [True] * len(out), [0] * len(out)
    hit = [i for i, f in enumerate(found) if f]
    if not hit:
        return out, kept, lost
    units = Prints([texts[i] for i in hit])
    words, each = units.words, units.hash.view(np.int64)
    text_start = np.concatenate(([0], words.text_ends[:-1]))
    for k, i in enumerate(hit):
        lo, hi = int(units.first[k]), int(units.first[k + 1])
        gone = _gone(each[lo:hi], units.print[lo : max(lo, hi - SHINGLE + 1)].view(np.int64), found[i])
        if not gone.any():
            continue
        lost[i] = int(gone.sum())
        if gone.all():
            out[i], kept[i] = "", False
            continue
        raw = texts[i].encode("utf-8", "surrogatepass")
        begin, end = words.starts[lo:hi] - text_start[k], words.ends[lo:hi] - text_start[k]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        parts, at = [], 0
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):  # a run goes with the white space behind it
            parts.append(raw[at : begin[a]])
            at = int(begin[b]) if b < hi - lo else int(end[b - 1])
            if b < hi - lo and b"\n" in raw[end[b - 1] : at] and parts[-1] and not parts[-1].endswith(b"\n"):
                parts.append(b"\n")
        parts.append(raw[at:])
        out[i] = b"".join(parts).decode("utf-8", "surrogatepass")
    return out, kept, lost
