"""Operator 9: canonical exact fingerprints, with DataFrame and SQL functions only.

A text is put into NFKC, case-folded, and its white space becomes single spaces without any at the
ends; four xxhash64 values of different seeds make the fingerprint. Texts whose fingerprints are
equal are then compared byte by byte with the least of their bucket; a text that differs gets its
sha256 behind the fingerprint, so equal fingerprints mean equal canonical texts.

The next document in descending doc_id comes without a global sort: ids are cut into ranges, each
range is ordered by itself, and the first document of the next lower range stands behind it as a
guard. Only the ranges' bounds, at most MOST_RANGES numbers, pass the driver.

Defined cases: a null text is empty; a null doc_id sorts below all others; rows of one id are in the
order of their texts; the next document of the last is the first, which may be itself; likeness is
1 for equal canonical texts, else 0. Extra columns are not read. Empty in, empty out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.session import checkpointed

PER_RANGE, MOST_RANGES = 2000, 20_000
#: Hashes that occur more than once are broadcast up to this number (32 bytes each), else shuffled.
BROADCAST_HASHES = 500_000
#: White space other than the space, and runs of white space; single spaces stay as they are.
_ANY = r"\x09-\x0D\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_WHITE = rf"[{_ANY}][{_ANY}\x20]*|\x20[{_ANY}\x20]+"
_LEAST = -(2**63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again as folding can undo it, and single spaces; for ASCII that is lower case."""
    text = F.coalesce(text, F.lit(""))
    normal = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(text), F.lit(True))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(normal(folded))
    return F.trim(F.regexp_replace(plain, _WHITE, " "))


def wide_hash(canon: Column) -> Column:
    """64 hexadecimal digits of four xxhash64 values."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2, 3, 4)))


def collisions(docs: DataFrame) -> DataFrame:
    """(print, digest): the texts that share a hash with a lesser canonical text but not its bytes."""
    prints = checkpointed(docs.select("doc_id", canonical(F.col("text")).alias("canon")).select("doc_id", wide_hash(F.col("canon")).alias("print")))
    repeated = checkpointed(prints.groupBy("print").count().filter("count > 1").select("print"))
    ids = prints.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_HASHES else repeated, "print", "left_semi").select("doc_id")
    ids = checkpointed(ids.filter("doc_id is not null").distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST_HASHES else ids
    texts = docs.select("doc_id", "text")
    again = texts.join(few, "doc_id", "left_semi").unionByName(texts.filter("doc_id is null")).select(canonical(F.col("text")).alias("canon"))
    held = checkpointed(again.select("canon", wide_hash(F.col("canon")).alias("print")))
    # salted, so that the copies of one text don't meet in one task before they are one
    least = held.groupBy("print", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt")).agg(F.min("canon").alias("canon")).groupBy("print").agg(F.min("canon").alias("least"))
    return held.join(least, "print").filter("canon <> least").select("print", F.sha2("canon", 256).alias("digest")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)))


def _range_of(keyed: DataFrame) -> Column:
    """The range of a key, where lower ids are in lower ranges."""
    n = keyed.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / PER_RANGE)))
    bounds = keyed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0)
    steps = [2**k for k in reversed(range(len(bounds).bit_length()))]
    listed = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(listed, at + step - 1) < F.col("key")), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): each row beside the next in descending doc_id, the first after the last."""
    rows = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    range_ = _range_of(rows)
    heads = checkpointed(rows.groupBy(range_.alias("range")).agg(F.max("key").alias("key")))
    first = rows.select("key", "text").join(F.broadcast(heads.select("key")), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    down = Window.orderBy(F.desc("range"))  # over ranges, at most MOST_RANGES rows
    top = F.first("key").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guards = heads.select("range", F.coalesce(F.lead("key").over(down), top).alias("key")).join(first, "key")
    both = rows.withColumns({"guard": F.lit(0), "range": F.lit(None).cast("int")}).unionByName(guards.select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text", "key", F.lit(1).alias("guard"), "range"))
    # after the union: a union whose side derives its range by a lambda fails in the optimizer ("key not found") in some sessions
    both = both.withColumn("range", F.coalesce("range", range_))
    both = both.withColumn("canon", canonical(F.col("text"))).withColumn("print", wide_hash(F.col("canon"))).drop("canon")
    order = Window.partitionBy("range").orderBy("guard", F.desc("key"), "text")
    return both.withColumns({"next_text": F.lead("text").over(order), "next_print": F.lead("print").over(order)}).filter("guard = 0").select("doc_id", "text", "print", "next_text", "next_print")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("canon_edited", canonical(F.col("edited"))).withColumn("edited_print", wide_hash(F.col("canon_edited")))
    # bytes are only compared, and so made canonical, where the hashes are equal
    same = lambda prints, other: F.coalesce(F.when(prints, canonical(F.col("text")) == other), F.lit(False)).cast("double")
    rows = rows.withColumns({"near_edited": same(F.col("print") == F.col("edited_print"), F.col("canon_edited")), "near_next": same(F.col("print") == F.col("next_print"), canonical(F.col("next_text")))})
    out = {"n_chars": n.cast("long"), "edited_sha256": F.sha2("edited", 256), "fingerprint": F.col("print"), "edited_fingerprint": F.col("edited_print")}
    clash = checkpointed(collisions(docs))
    if not clash.isEmpty():  # few if any; a text that isn't its bucket's least gets its digest behind the hash
        for column, print_, canon in (("fingerprint", "print", canonical(F.col("text"))), ("edited_fingerprint", "edited_print", F.col("canon_edited"))):
            rows = rows.withColumn(f"_{print_}", F.sha2(canon, 256)).join(clash.select(F.col("print").alias("_p"), F.col("digest").alias("_d"), F.lit(True).alias(f"_hit_{print_}")), (F.col(print_) == F.col("_p")) & (F.col(f"_{print_}") == F.col("_d")), "left").drop("_p", "_d")
            out[column] = F.when(F.col(f"_hit_{print_}"), F.concat(print_, F.lit("-"), F.col(f"_{print_}"))).otherwise(F.col(print_))
    return rows.withColumns(out).select("doc_id", *out, "near_edited", "near_next")


def exact_copies(docs: DataFrame) -> DataFrame:
    """(fingerprint, least_doc_id, copies) of each distinct canonical text."""
    hashed = docs.select("doc_id", canonical(F.col("text")).alias("canon")).select("doc_id", wide_hash(F.col("canon")).alias("fingerprint"))
    return hashed.groupBy("fingerprint").agg(F.min("doc_id").alias("least_doc_id"), F.count("*").alias("copies"))
