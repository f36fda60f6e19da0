"""Registered queries of rules, keys and orders, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtally.functions import scalars
from gridtally.operators import registry, rules, stats
from gridtally.projections import dosages, table
from gridtally.registered import query


def _text(c):
    return F.col(c).cast("string")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def last_entries(spark, d):
    """A registry read by key: of rows with one key the last counts."""
    return registry.last_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("""WITH e AS (SELECT DISTINCT 'seg' || s_nationkey AS base, s_suppkey % 7 + 1 AS v FROM supplier), p AS (SELECT c_custkey AS id, 'seg' || c_nationkey AS base, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
f AS (SELECT base, n AS v, row_number() OVER (PARTITION BY base ORDER BY n) AS k FROM (SELECT DISTINCT base FROM p) b, range(1, 100) t(n) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.base = b.base AND e.v = n))
SELECT p.id AS proposal, p.base || coalesce('_v' || f.v, '_v_TODO') AS version_id FROM p LEFT JOIN f ON f.base = p.base AND f.k = p.k""")
def version_ids(spark, d):
    """New ids beside those that are taken, a nation's customers in turn; past a hundred they are left to do."""
    proposed = table(spark, d, "customer").select(F.col("c_custkey").alias("proposal"), F.concat(F.lit("seg"), _text("c_nationkey")).alias("base"))
    taken = table(spark, d, "supplier").select(F.concat(F.lit("seg"), _text("s_nationkey"), F.lit("_v"), (F.col("s_suppkey") % 7 + 1).cast("string")).alias("id")).distinct()
    return registry.fresh_versions(proposed, taken)


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_retailprice > 1500, CASE WHEN p_retailprice <= 1500 THEN p_size END, CASE WHEN p_retailprice > 1500 THEN 'scaffold_' || p_partkey END, p_partkey) AS place FROM part""")
def natural_names(spark, d):
    """Places of chromosome names in natural order, by hundreds of parts; scaffolds come last. Parts of one name go by their number."""
    name = F.when(F.col("p_retailprice") > 1500, F.concat(F.lit("scaffold_"), _text("p_partkey"))).otherwise(F.concat(F.lit("LG"), F.lpad(_text("p_size"), 2, "0")))
    w = Window.partitionBy(F.floor(F.col("p_partkey") / 100)).orderBy(*registry.natural_order(name), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT l_orderkey AS id, CASE WHEN sum(l_extendedprice) >= 200000 THEN 'double_crossover' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'gene_conversion_embedded' ELSE 'single_crossover_or_ambiguous' END AS class FROM lineitem GROUP BY 1""")
def event_classes(spark, d):
    """Recombination events by length and by tracts inside."""
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("bp"), F.count_if(F.col("l_returnflag") == "R").alias("tracts"))
    return sums.select("id", rules.event_class(F.col("bp"), F.col("tracts")).alias("class"))


@query("""SELECT l_orderkey, l_linenumber, l_linestatus AS version, o_orderstatus AS current_version FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON o_orderkey = l_orderkey WHERE l_linestatus IS DISTINCT FROM o_orderstatus""")
def stale_versions(spark, d):
    """Lines whose status isn't their order's, or whose order is gone."""
    stored = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("version"))
    current = table(spark, d, "orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("version"))
    return rules.stale(stored, current, "l_orderkey")


@query("""SELECT p_partkey, coalesce(list_position(['NONE', 'UNCERTAIN', 'SUPPORTED', 'VALIDATED'], ['NONE', 'UNCERTAIN', 'SUPPORTED', 'VALIDATED', 'SUSPECT', NULL][p_size % 6 + 1]) >= 3, false) AS passes FROM part""")
def version_gates(spark, d):
    """Whether a part's validation reaches SUPPORTED."""
    rank = F.get(F.array(*map(F.lit, ("NONE", "UNCERTAIN", "SUPPORTED", "VALIDATED", "SUSPECT", None))), F.col("p_size") % 6)
    return table(spark, d, "part").select("p_partkey", rules.version_gate(rank, "SUPPORTED").alias("passes"))


@query("""WITH p AS (SELECT user_id, CASE WHEN event_id % 5 = 0 AND user_id % 3 = 0 THEN 'two_block' WHEN event_id % 17 = 0 THEN 'multi_block' WHEN event_id % 4 = 0 AND user_id % 2 = 0 THEN 'noisy' ELSE 'homogeneous' END AS t FROM events), s AS (SELECT user_id, count(*) FILTER (t = 'homogeneous') / count(*) AS h, count(*) FILTER (t IN ('two_block', 'multi_block')) / count(*) AS b FROM p GROUP BY 1)
SELECT user_id, CASE WHEN h >= 0.8 THEN 'clean' WHEN b > 0.2 THEN 'likely' WHEN b >= 0.05 THEN 'maybe' ELSE 'unclear' END AS flag FROM s""")
def composite_flags(spark, d):
    """Users by the patterns of their events."""
    e, u = F.col("event_id"), F.col("user_id")
    pattern = F.when((e % 5 == 0) & (u % 3 == 0), "two_block").when(e % 17 == 0, "multi_block").when((e % 4 == 0) & (u % 2 == 0), "noisy").otherwise("homogeneous")
    return rules.composite_flag(table(spark, d, "events").select("user_id", pattern.alias("pattern")), "user_id")


@query("""WITH e AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN 'layer-' || o_orderkey END AS i, CASE WHEN o_orderstatus = 'F' THEN 'dosage' WHEN o_orderstatus = 'O' THEN 'Dosage' END AS t, o_orderpriority AS g, CASE WHEN o_orderkey % 4 = 0 THEN 'active' WHEN o_orderkey % 4 = 1 THEN 'gone' WHEN o_orderkey % 4 = 2 THEN 'stale' END AS s FROM orders)
SELECT o_orderkey, concat_ws('|', CASE WHEN i IS NULL THEN 'missing layer_id' END, CASE WHEN t IS NULL THEN 'missing layer_type' END, CASE WHEN s IS NULL THEN 'missing status' END, CASE WHEN i IS NOT NULL THEN 'invalid layer_id' END, CASE WHEN t = 'Dosage' THEN 'invalid layer_type' END, CASE WHEN g <> 'staging' THEN 'invalid stage' END, CASE WHEN s = 'gone' THEN 'invalid status' END) AS problems FROM e""")
def envelope_checks(spark, d):
    """What is wrong with envelopes made of orders."""
    k, c, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(c % 5 > 0, F.concat(F.lit("layer-"), _text("o_orderkey"))).alias("layer_id"), F.when(status == "F", "dosage").when(status == "O", "Dosage").alias("layer_type"), F.lit("v1").alias("schema_version"), F.col("o_orderpriority").alias("stage"), F.lit("set").alias("dataset_id"),
        F.when(k % 4 == 0, "active").when(k % 4 == 1, "gone").when(k % 4 == 2, "stale").alias("status"), F.lit("now").alias("created_at"),
    )
    return rows.select("o_orderkey", F.array_join(rules.envelope_problems(), "|").alias("problems"))


@query("""SELECT c_custkey, lpad(lower(to_hex(list_reduce(list_prepend(2166136261, list_transform(string_split(c_mktsegment || c_custkey, ''), lambda x: ascii(x)::BIGINT)), lambda h, c: (xor(h, c & 255) * 16777619) & 4294967295))), 8, '0') AS hash FROM customer""")
def key_hashes(spark, d):
    """FNV-1a hashes of customers' keys."""
    return table(spark, d, "customer").select("c_custkey", scalars.fnv1a_32(F.concat("c_mktsegment", _text("c_custkey"))).alias("hash"))


@query("""WITH dos AS (SELECT l_partkey AS site, l_suppkey AS sample, least(2, count(*) - 1) AS x, 'g' || (l_suppkey % 2) AS g FROM lineitem GROUP BY l_partkey, l_suppkey), f AS (SELECT g, site, site // 50 AS w, count(*) AS n, sum(x) AS alt FROM dos GROUP BY ALL),
v AS (SELECT g, w, count(*) AS n_sites, sum((alt > 0 AND alt < 2 * n)::INT)::BIGINT AS s, sum((2 * alt * (2 * n - alt) / (2 * n * (2 * n - 1)))::DECIMAL(38,12))::DOUBLE AS pi, 2 * (sum(n) // count(*)) AS m FROM f GROUP BY ALL),
c AS (SELECT *, list_sum(list_transform(range(1, m::BIGINT), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, m::BIGINT), lambda i: 1.0::DOUBLE / (i * i))) AS a2, (m + 1)::DOUBLE / (3 * (m - 1)) AS b1, 2 * (m * m + m + 3)::DOUBLE / (9 * m * (m - 1)) AS b2 FROM v),
e AS (SELECT *, (b1 - 1 / a1) / a1 AS e1, (b2 - (m + 2) / (a1 * m) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM c) SELECT g AS group_name, w::BIGINT AS win_idx, n_sites, s, CASE WHEN s > 0 AND m > 2 THEN round((pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 5) END AS d FROM e""")
def window_tajima(spark, d):
    """Tajima's D of each window and group, from the window's own counts."""
    return stats.window_tajima(stats.frequencies(dosages(spark, d)), 50).withColumn("d", F.round("d", 5))
