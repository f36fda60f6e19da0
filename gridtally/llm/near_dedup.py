"""Operator 2: near-duplicate documents by fast similarity sketching.

A sketch has COORDINATES bins. In round i every shingle is hashed into one bin with the value
(i, hash), and a bin keeps its least value; rounds go on until every bin of the document is
filled, and after COORDINATES rounds each further round fills one bin directly, so all are filled
after twice as many. Bands of ROWS coordinates give the candidates: BANDS bands miss a pair of
similarity 0.8 with probability (1 - 0.8**ROWS)**BANDS, about 3 in a million.

Texts with equal shingle sets (of equal 128-bit digests of the sorted set) are first put together, so copies never meet in a bucket.
In a bucket, members are first compared with one member (its hub), not with each other, and linked
members become one class. Where a bucket then holds several classes, members whose own shingles
prove that they have no link in it are set aside; the others are compared with the most central
one, and with each other only where a prefix filter on their differences from it leaves a link
possible. All links are confirmed on the full sets of shingles (as 64-bit hashes of their words' XXH3 values), so no class is
joined by a sketch alone, and no pair that shares a bucket stays unproven.

Defined cases: a document without words, or a null text, has an empty set and is linked with
nothing; rows that share a doc_id share a component; a null doc_id is its own class (component
null, kept). Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.links import forest
from gridtally.llm.texts import FlatWords, mix, releasing, text_slices
from gridtally.session import checkpointed

ROWS, BANDS = 5, 32
COORDINATES = ROWS * BANDS
SLICE_CHARS = 1_000_000
#: Ids are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as (text, hash), ordered by text, then hash."""
    words = FlatWords(texts, fold=True)
    h, text_of, counts = words.hashes(), words.text_of, words.counts
    base = np.uint64(0xD6E8FEB86659FD93)
    if len(h) >= width:
        g = h[: len(h) - width + 1]
        for k in range(1, width):
            g = g * base + h[k : len(h) - width + 1 + k]
        whole = text_of[width - 1 :] == text_of[: len(h) - width + 1]
        g, owner = mix(g[whole]), text_of[: len(h) - width + 1][whole]
    else:
        g, owner = h[:0], text_of[:0]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        few = []
        for i in short.tolist():
            x = np.uint64(counts[i])
            for y in h[first[i] : first[i] + counts[i]]:
                x = np.uint64((int(x) * int(base) + int(y)) & (2**64 - 1))
            few.append(int(x))
        g = np.concatenate((g, mix(np.array(few, np.uint64), 1)))
        owner = np.concatenate((owner, short))
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    g, owner = g[order], owner[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], g[fresh]


def sketches(owner: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """n sketches of COORDINATES values; rows of texts without shingles stay unfilled."""
    t = COORDINATES
    empty = np.uint64(2**64 - 1)
    out = np.full(n * t, empty, np.uint64)
    for i in range(2 * t):
        if not len(g):
            break
        if i < t:
            h = mix(g, i + 1)
            place = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        else:
            h = mix(g, i + 1)
            place = i - t
        at = owner * t + place
        value = np.uint64(i << 48) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(out, at, value)
        full = ~(out.reshape(n, t) == empty).any(axis=1) if i < 8 or i % 8 == 0 else None
        if full is not None and full.any():
            keep = ~full[owner]
            owner, g = owner[keep], g[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k], 7)
    return key


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                owner, g = shingles(texts, width)
                n = len(texts)
                size = np.bincount(owner, minlength=n)
                keys = band_keys(sketches(owner, g, n)).view(np.int64)
                filled = size > 0
                offsets = np.concatenate(([0], np.cumsum(np.where(filled, BANDS, 0)))).astype(np.int32)
                cut = np.concatenate(([0], np.cumsum(size)))
                raw = g.tobytes()
                digest = np.frombuffer(b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(cut.tolist(), cut[1:].tolist())), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(size, pa.int64()),
                        pa.array(digest[0::2]),
                        pa.array(digest[1::2]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[filled].reshape(-1))),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, members) with the shingle hashes of each row."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                owner, g = shingles(texts, width)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(g.view(np.int64)))], ["id", "members"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "id long, members array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("of_b")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("members").alias("of_a")), "a")
    # sizes that differ too much need no intersection
    small, large = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
    common = F.when(100 * small >= percent * large, F.size(F.array_intersect("of_a", "of_b"))).otherwise(0)
    both = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return both.filter((F.col("common") > 0) & (100 * F.col("common") >= percent * (F.col("total") - F.col("common")))).select("a", "b")


def _able(bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members of buckets of several classes that can still have a link there, with a central document as hub.

    Linked sets share at least percent / (100 + percent) of the sum of their sizes. Shingles that no
    other of these documents has are never shared, so a document with too many of them, against the
    smallest member of its bucket, has no link in it. The bucket's hub is the document with the fewest
    in the class of the member with the fewest, so the buckets of one class have one hub; it need not
    be in the bucket.
    """
    members = bands.select("rep").distinct()
    held = sets.join(members, F.col("id") == F.col("rep"), "left_semi")
    once = held.select("id", F.explode("members").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    sizes = held.select("id", F.size("members").alias("n")).groupBy("id").agg(F.max("n").alias("n")).join(once, "id", "left").select(F.col("id").alias("rep"), "n", F.coalesce("alone", F.lit(0)).alias("alone"))
    sized = checkpointed(bands.join(sizes, "rep"))
    least = sized.groupBy("band", "key").agg(F.min("n").alias("least"))
    able = sized.join(least, ["band", "key"]).filter((100 + percent) * (F.col("n") - F.col("alone")) >= percent * (F.col("n") + F.col("least")))
    order = F.struct(F.col("alone") / F.col("n"), F.col("rep"))
    several = able.groupBy("band", "key").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.min_by("of", order).alias("central")).filter("x < y").select("band", "key", "central")
    several = several.join(able.groupBy(F.col("of").alias("central")).agg(F.min_by("rep", order).alias("hub")), "central").select("band", "key", "hub")
    return able.select("band", "key", "rep", "of").join(several, ["band", "key"])


def _around_hubs(able: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with the hubs, and pairs (a, b) that may be links between other members of a hub's buckets.

    Let D be the shingles that a member has and its hub has not, or the other way round. Two members are
    linked if and only if their D differ in at most r times the sum of their sizes, r = (100 - percent) /
    (100 + percent), so their D must share a certain number of shingles, and hence one among the first few
    of each in the order of rarity. Where the first shingle that they share stands, in either order, as many
    shingles must follow it as they have to share besides; those of one member alone come first and follow none. Edits
    of one text are mostly rare, so few members meet, and no pair that is a link is left out.
    Members linked with the hub are of one class and need not meet.
    """
    pairs = able.select("hub", "rep", "of").distinct().filter("hub <> rep")
    joined = pairs.join(sets.select(F.col("id").alias("rep"), F.col("members").alias("own")), "rep").join(sets.select(F.col("id").alias("hub"), F.col("members").alias("base")), "hub")
    apart = F.concat(F.array_except("own", "base"), F.array_except("base", "own"))
    held = joined.select("hub", "rep", "of", F.size("own").alias("n"), F.size("base").alias("m"), apart.alias("apart"))
    linked = (100 + percent) * F.size("apart") <= (100 - percent) * (F.col("n") + F.col("m"))
    held = checkpointed(held.withColumn("linked", linked))
    d, r = F.size("apart"), (100 - percent) / (100 + percent)
    # the least number of shared shingles: with any member not linked to the hub, and of such a one with a linked member
    among = F.greatest(F.lit(1), F.ceil((d + r * (F.col("m") - F.col("n"))) / 2 - 1e-6))
    across = F.greatest(F.lit(1), F.ceil((d - r * (F.col("n") + F.col("m"))) / 2 - 1e-6))
    facts = held.select("hub", "rep", "of", "linked", d.alias("d"), (d - r * F.col("n")).alias("excess"), (d - among + 1).alias("first_among"), (d - F.when(F.col("linked"), among).otherwise(across) + 1).alias("first_across"))
    each = held.select("hub", "rep", F.explode("apart").alias("s"))
    # shingles of one member alone are the rarest and never meet; they only push the others back
    times = each.groupBy("hub", "s").agg(F.count("*").alias("times")).filter("times > 1")
    own = Window.partitionBy("hub", "rep")
    ranked = each.join(times, ["hub", "s"]).withColumn("rank", F.row_number().over(own.orderBy("times", "s"))).withColumn("shared", F.count("*").over(own))
    ranked = ranked.join(facts, ["hub", "rep"]).withColumn("place", F.col("d") - F.col("shared") + F.col("rank")).filter(F.col("place") <= F.greatest("first_among", "first_across"))
    ranked = checkpointed(ranked.select("hub", "s", "rep", "of", "linked", "excess", (F.col("shared") - F.col("rank") + 1).alias("left"), (F.col("place") <= F.col("first_among")).alias("among"), (F.col("place") <= F.col("first_across")).alias("across")))
    side = lambda k: ranked.select("hub", "s", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "of", "linked", "excess", "left", "among", "across")))
    one, two = side("a").filter("not linked_a"), side("b")
    met = one.join(two, ["hub", "s"]).filter("of_a <> of_b and ((linked_b and across_a and across_b) or (not linked_b and rep_a < rep_b and among_a and among_b)) and 2 * least(left_a, left_b) >= excess_a + excess_b - 1e-6")
    links = held.filter("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    return links, met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = checkpointed(_sketched(docs, width))
    known = rows.filter("doc_id is not null and n_shingles > 0")

    # one representative for each distinct set
    equal = known.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "keys")).alias("least"))
    equal = checkpointed(equal.select("set_a", "set_b", F.col("least.doc_id").alias("rep"), F.col("least.keys").alias("keys")))
    bands = equal.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("band", "key", "hub")
    bands = checkpointed(bands.join(shared, ["band", "key"]))

    ids = bands.select(F.col("rep").alias("doc_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = checkpointed(_sets(docs.join(ids, "doc_id", "left_semi"), width))

    pairs = checkpointed(bands.filter("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    tree = forest(confirmed(pairs, sets, percent))
    classed = bands.join(tree.withColumnRenamed("node", "rep"), "rep", "left").select("band", "key", "rep", F.coalesce("root", "rep").alias("of"))
    several = classed.groupBy("band", "key").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x < y").select("band", "key")
    able = checkpointed(_able(checkpointed(classed.join(several, ["band", "key"])), sets, percent))
    if not able.isEmpty():
        with_hubs, others = _around_hubs(able, sets, percent)
        old = tree.select(F.col("node").alias("a"), F.col("root").alias("b"))
        tree = forest(old.union(with_hubs).union(confirmed(checkpointed(others), sets, percent)))

    same_id = known.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("x"), F.max(F.struct("set_a", "set_b")).alias("y")).filter("x <> y").select("doc_id")
    # a document's class: through its set's representative, and through rows that share its id
    own = known.join(equal.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("doc_id", "rep").distinct()
    if not same_id.isEmpty():
        more = own.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        tree = forest(more.union(tree.select("node", "root")))
        own = own.groupBy("doc_id").agg(F.min("rep").alias("rep"))
        own = own.select("doc_id", F.least("doc_id", "rep").alias("rep"))
    classes = own.join(tree.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(classes, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def oracle(width: int = 4, percent: int = 80) -> str:
    """DuckDB SQL for near_classes(documents), by all pairs that share a shingle; for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS d, a AS m FROM u UNION SELECT r.d, u.b FROM r JOIN u ON u.a = r.m), m AS (SELECT d, min(m) AS m FROM r GROUP BY d)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.m, w.doc_id)::BIGINT AS component_id, coalesce(m.m, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.d = w.doc_id"""
