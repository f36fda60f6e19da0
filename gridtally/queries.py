"""The registered queries of the reference's operators on the driver's tables, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally import queries_lookups, queries_models, queries_registry, queries_rules  # noqa: F401  they register their queries
from gridtally.functions import scalars
from gridtally.operators import graph, intervals, registry, rules, sampling, sets, stats
from gridtally.projections import chrom_sizes, dosages, event_sites, order_intervals, table
from gridtally.registered import ORACLES, QUERIES, query  # noqa: F401
from gridtally.streaming import log

SITES = """sites AS (SELECT event_type AS chrom, date_diff('second', TIMESTAMP '2024-01-01', ts) + 1 AS pos, event_id AS site_id, user_id AS sample, value,
  2 * ((event_id % 101) / 100.0) * (1 - (event_id % 101) / 100.0) AS hexp,
  greatest(0.0, least(1.0, 2 * ((event_id % 101) / 100.0) * (1 - (event_id % 101) / 100.0) * (1 - ((event_id % 21) - 10) / 10.0))) AS hobs FROM events)"""

DOSAGES = "dos AS (SELECT l_partkey AS site, l_suppkey AS sample, least(2, count(*) - 1) AS x, 'g' || (l_suppkey % 2) AS g FROM lineitem GROUP BY l_partkey, l_suppkey)"

SPANS = "iv AS (SELECT 'LG' || lpad(c_nationkey::VARCHAR, 2, '0') AS chrom, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT + 30 AS e, o_orderkey AS id, o_totalprice / 1000 AS score, o_custkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey)"


def _hobs_sql(scales, by: str = "") -> str:
    parts = []
    for label, win, step in scales:
        grp = f"{by} AS grp, " if by else ""
        keys = "grp, " if by else ""
        on = " AND s.grp = g.grp" if by else ""
        parts.append(f"""SELECT '{label}' AS scale, {'g.grp AS grp, ' if by else ''}g.chrom, g.k AS win_idx, g.a AS win_start, g.b AS win_end, (g.a + g.b) // 2 AS center,
          sum(hobs::DECIMAL(38,9))::DOUBLE / nullif(count(site_id), 0) AS mh, sum(hexp::DECIMAL(38,9))::DOUBLE / nullif(count(site_id), 0) AS me, count(site_id) AS n
          FROM (SELECT {keys}chrom, k, k * {step} + 1 AS a, least(k * {step} + {win}, 2592000) AS b FROM (SELECT DISTINCT {grp}chrom FROM sites), (SELECT unnest(range(0, (2592000 - 1) // {step} + 1)) AS k)) g
          LEFT JOIN (SELECT *{', ' + by + ' AS grp' if by else ''} FROM sites) s ON s.chrom = g.chrom AND s.pos BETWEEN g.a AND g.b{on} GROUP BY ALL""")
    return f"""WITH {SITES}, w AS ({' UNION ALL '.join(parts)})
    SELECT scale, {'grp, ' if by else ''}chrom, win_idx::BIGINT AS win_idx, win_start::BIGINT AS win_start, win_end::BIGINT AS win_end, center::BIGINT AS center, mh AS mean_hobs, me AS mean_hexp,
    CASE WHEN me > 1e-12 THEN mh / me END AS hover_e, n::BIGINT AS n_sites FROM w"""


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_WIDE = [("100kb", 100_000, 20_000)]
_FINE = [("600", 600, 200)]
_SCALES = [("50kb", 50_000, 10_000), ("200kb", 200_000, 50_000)]


@query(_hobs_sql(_WIDE))
def hobs_windows(spark, d):
    sites = intervals.heterozygosity(event_sites(spark, d))
    return intervals.windowed_heterozygosity(sites, chrom_sizes(spark, d), _WIDE)


@query(_hobs_sql(_FINE))
def hobs_windows_fine(spark, d):
    """Small windows, many of them without a site."""
    sites = intervals.heterozygosity(event_sites(spark, d))
    return intervals.windowed_heterozygosity(sites, chrom_sizes(spark, d), _FINE)


@query(_hobs_sql(_SCALES, "sample % 3"))
def hobs_groupwise(spark, d):
    """Two scales and three groups of samples in one plan."""
    sites = intervals.heterozygosity(event_sites(spark, d)).withColumn("grp", F.col("sample") % 3)
    return intervals.windowed_heterozygosity(sites, chrom_sizes(spark, d), _SCALES, ["grp"])


@query(f"""WITH {SITES}, st AS (SELECT chrom, (pos - 1) // 20000 AS k, sum(value::DECIMAL(38,9)) AS t, count(*) AS n FROM sites GROUP BY ALL)
SELECT a.chrom, a.k::BIGINT AS win_idx, round(sum(b.t)::DOUBLE, 4) AS total, sum(b.n)::BIGINT AS n FROM st a JOIN st b ON a.chrom = b.chrom AND b.k BETWEEN a.k AND a.k + 24 GROUP BY a.chrom, a.k""")
def step_window_sums(spark, d):
    """Wide windows from sums over steps."""
    s = intervals.step_sums(event_sites(spark, d), "value", 500_000, 20_000)
    return s.select("chrom", "win_idx", F.round(F.col("total").cast("double"), 4).alias("total"), "n")


@query(f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY chrom ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS o FROM iv WHERE score >= 350),
r AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s, e, id) AS r FROM f), m AS (SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n, min(id) AS least_id FROM r GROUP BY chrom, r)
SELECT chrom || '_INV_' || CASE WHEN rn < 1000 THEN lpad(rn::VARCHAR, 3, '0') ELSE rn::VARCHAR END AS candidate_id, chrom, s AS start, e AS "end", n AS members, least_id FROM (SELECT *, row_number() OVER (ORDER BY chrom, s) AS rn FROM m)""")
def interval_merge(spark, d):
    """Gaps and islands, with ids that run over all chromosomes."""
    merged = intervals.merge_intervals(order_intervals(spark, d).filter("band_score >= 350"), 1)
    out = intervals.minted(merged, ["chrom", "start"], F.concat("chrom", F.lit("_INV_")))
    return out.select("candidate_id", "chrom", "start", "end", "members", F.array_min("ids").alias("least_id"))


@query(f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY chrom ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS o FROM iv WHERE score >= 350),
r AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s, e, id) AS r FROM f), m AS (SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n FROM r GROUP BY chrom, r),
q AS (SELECT *, row_number() OVER (ORDER BY chrom, s) AS rn FROM m),
c AS (SELECT chrom, s, e, n, chrom || '_INV_' || CASE WHEN rn < 1000 THEN lpad(rn::VARCHAR, 3, '0') ELSE rn::VARCHAR END AS cid FROM q),
h AS (SELECT c.cid, count(p.pos) AS l3 FROM c LEFT JOIN (SELECT chrom, s AS pos FROM iv WHERE status = 'P') p ON p.chrom = c.chrom AND p.pos BETWEEN c.s AND c.e GROUP BY c.cid),
b AS (SELECT c.cid, count(p.s) AS dh FROM c LEFT JOIN (SELECT chrom, s, e FROM iv WHERE priority = '1-URGENT') p ON p.chrom = c.chrom AND p.s >= c.s AND p.e <= c.e GROUP BY c.cid)
SELECT c.cid AS candidate_id, c.chrom, c.s AS start, c.e AS "end", c.n AS band_count, l3 AS l3_hits, dh AS dosage_hits, CASE WHEN l3 >= 2 AND dh >= 1 THEN 'high' WHEN l3 >= 1 OR dh >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM c JOIN h USING (cid) JOIN b USING (cid)""")
def candidate_promoter(spark, d):
    """Merged bands with the points and bins inside them, and their confidence."""
    iv = order_intervals(spark, d)
    points = iv.filter("status = 'P'").select("chrom", F.col("start").alias("pos"))
    bins = iv.filter("priority = '1-URGENT'").select("chrom", "start", "end")
    return intervals.candidate_table(iv, points, bins, 350.0, 1, 128)


@query(f"""WITH {SPANS}, h AS (SELECT p.id AS point_id, first(i.id ORDER BY i.e - i.s, i.id) AS interval_id FROM (SELECT chrom, s AS pos, id FROM iv) p JOIN (SELECT chrom, s, s + (id % 40) AS e, id FROM iv WHERE priority = '1-URGENT') i ON p.chrom = i.chrom AND p.pos BETWEEN i.s AND i.e GROUP BY p.id) SELECT point_id, interval_id FROM h""")
def smallest_interval(spark, d):
    """The shortest interval of an urgent order around each point."""
    iv = order_intervals(spark, d)
    points = iv.select("chrom", F.col("start").alias("pos"), F.col("interval_id").alias("point_id"))
    shapes = iv.filter("priority = '1-URGENT'").select("chrom", "start", (F.col("start") + F.col("interval_id") % 40).alias("end"), "interval_id")
    return intervals.smallest_containing(points, shapes, 64, ["point_id"])


@query(f"""WITH {SPANS} SELECT a.id AS a_id, b.id AS b_id, (least(a.e, b.e) - greatest(a.s, b.s) + 1)::BIGINT AS shared FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e WHERE a.priority = '1-URGENT' AND b.status = 'P'""")
def interval_overlaps(spark, d):
    """Urgent orders and pending ones whose days overlap."""
    iv = order_intervals(spark, d)
    side = lambda p, role: iv.filter(role).select("chrom", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("interval_id").alias(f"{p}_id"))
    both = intervals.overlaps(side("a", "priority = '1-URGENT'"), side("b", "status = 'P'"), 64)
    return both.select("a_id", "b_id", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1).alias("shared"))


@query(f"""WITH {SITES}, st AS (SELECT * FROM sites WHERE value < 50), p AS (SELECT chrom, pos, site_id FROM sites)
SELECT p.site_id AS point_id, first(st.site_id ORDER BY abs(st.pos - p.pos), st.pos, st.site_id) AS site_id FROM p JOIN st ON p.chrom = st.chrom GROUP BY p.site_id""")
def nearest_site(spark, d):
    """For every event the nearest one of a value below 50: as-of in both directions; the lower site wins a tie."""
    sites = event_sites(spark, d)
    points = sites.select("chrom", "pos", F.col("site_id").alias("point_id"))
    return sampling.nearest(points, sites.filter("value < 50").select("chrom", "pos", "site_id"))


@query(f"""WITH RECURSIVE {SITES}, n AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos, site_id) - 1 AS idx, min(pos) OVER (PARTITION BY chrom) AS lo, max(pos) OVER (PARTITION BY chrom) AS hi, count(*) OVER (PARTITION BY chrom) AS n FROM sites),
t AS (SELECT chrom, n, t, lo + (hi - lo) * (2 * t + 1) / 400.0::DOUBLE AS ta FROM (SELECT DISTINCT chrom, n, lo, hi FROM n WHERE n > 200), (SELECT unnest(range(200)) AS t)),
p AS (SELECT t.chrom, t.n, t.t, first(n.idx ORDER BY abs(n.pos - t.ta), n.pos, CASE WHEN n.pos <= t.ta THEN -n.idx ELSE n.idx END) AS pick FROM t JOIN n ON n.chrom = t.chrom GROUP BY ALL),
f AS (SELECT chrom, n, t, pick FROM p WHERE t = 0 UNION ALL SELECT p.chrom, p.n, p.t, CASE WHEN p.pick = f.pick THEN least(p.pick + 1, p.n - 1) ELSE p.pick END FROM f JOIN p ON p.chrom = f.chrom AND p.t = f.t + 1)
SELECT chrom, idx FROM n WHERE n <= 200 UNION ALL SELECT DISTINCT chrom, pick FROM f""")
def even_sites(spark, d):
    """200 sites of each chromosome, evenly by position."""
    return sampling.even_sample(event_sites(spark, d).select("chrom", "pos", "site_id"), 200)


@query(f"""WITH RECURSIVE {SITES}, n AS (SELECT chrom, pos, min(site_id) AS site_id FROM sites GROUP BY chrom, pos), j AS (SELECT chrom, pos, min(pos) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 3000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM n),
k AS (SELECT chrom, min(pos) AS pos FROM n GROUP BY chrom UNION ALL SELECT j.chrom, j.nx FROM k JOIN j ON j.chrom = k.chrom AND j.pos = k.pos WHERE j.nx IS NOT NULL) SELECT chrom, pos, site_id FROM k JOIN n USING (chrom, pos)""")
def greedy_thinning(spark, d):
    """Each kept site lies at least 3000 behind the one kept before."""
    return sampling.thin_greedy(event_sites(spark, d).select("chrom", "pos", "site_id"), 3000)


@query(f"WITH {SITES} SELECT chrom, (pos // 5000)::BIGINT AS bin, first(site_id ORDER BY md5(site_id || ':7'), site_id) AS site_id FROM sites GROUP BY chrom, pos // 5000")
def random_thinning(spark, d):
    return sampling.thin_random(event_sites(spark, d), 5000, 7)


@query(f"WITH {SITES}, n AS (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY pos, site_id) - 1) // 100 AS w FROM sites) SELECT chrom, w::BIGINT AS \"window\", min(pos) AS start, max(pos) AS \"end\", count(*) AS n FROM n GROUP BY chrom, w")
def windows_by_sites(spark, d):
    return sampling.windows_of_sites(event_sites(spark, d), 100)


@query("""WITH g(group_name, lo, hi) AS (VALUES ('low', 0, 4), ('high', 5, 9), ('none', 90, 99)), s AS (SELECT user_id AS sample, event_type AS win, avg(value) AS v, sum(value::DECIMAL(38,9))::DOUBLE / count(*) AS q FROM events GROUP BY ALL),
w AS (SELECT DISTINCT win FROM s), n AS (SELECT group_name, count(DISTINCT sample) AS n FROM g LEFT JOIN s ON sample % 12 BETWEEN lo AND hi GROUP BY group_name)
SELECT g.group_name, w.win, n.n, round(sum(round(q, 6)::DECIMAL(38,9))::DOUBLE / nullif(count(q), 0), 4) AS q1 FROM g CROSS JOIN w JOIN n ON n.group_name = g.group_name LEFT JOIN s ON s.win = w.win AND s.sample % 12 BETWEEN lo AND hi GROUP BY ALL""")
def ancestry_group_means(spark, d):
    """Group means per window, with an empty group."""
    long = table(spark, d, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("win")).agg(intervals.exact_mean("value").alias("q1")).withColumn("q1", F.round("q1", 6))
    samples = long.select("sample").distinct()
    part = F.when(F.col("sample") % 12 <= 4, "low").when(F.col("sample") % 12 <= 9, "high")
    groups = samples.select(part.alias("group_name"), "sample").filter("group_name is not null").union(spark.createDataFrame([("none", None)], "group_name string, sample long"))
    return _rounded(stats.group_means(long, groups, ["q1"], "win"), 4, "q1")


@query("""WITH s AS (SELECT l_returnflag AS win, l_linestatus AS sample, (100 * avg(l_discount))::INT AS a, (100 * avg(l_tax))::INT AS b FROM lineitem GROUP BY ALL)
SELECT k::INT AS k, win, count(*) AS n, round(sum((CASE WHEN k = 1 THEN a ELSE b END)::DECIMAL(38,9))::DOUBLE / count(*), 6) AS q FROM s, (VALUES (1), (2)) v(k) GROUP BY ALL""")
def ancestry_wide_cells(spark, d):
    """One column a sample with 'q1,q2' cells, taken apart again."""
    cells = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("win")).pivot("l_linestatus", ["F", "O"]).agg(F.concat_ws(",", F.rint(100 * F.avg("l_discount")).cast("int").cast("string"), F.rint(100 * F.avg("l_tax")).cast("int").cast("string")))
    long = stats.wide_cells(cells, "win", ["F", "O"])
    return long.groupBy("k", "win").agg(F.count("*").alias("n"), F.round(intervals.exact_mean("q"), 6).alias("q"))


@query(f"""WITH {DOSAGES}, f AS (SELECT site, g, count(*) AS n, sum(x)::BIGINT AS alt FROM dos WHERE x >= 0 GROUP BY site, g),
s AS (SELECT g, site // 50 AS w, n, alt, 2 * alt * (2 * n - alt) / (2 * n * (2 * n - 1))::DOUBLE AS pi, (alt > 0 AND alt < 2 * n)::INT AS seg FROM f),
w AS (SELECT g, w, count(*) AS n_sites, sum(seg)::BIGINT AS s, (sum(n) // count(*))::BIGINT AS mean_n, sum(pi::DECIMAL(38,12))::DOUBLE AS p FROM s GROUP BY g, w)
SELECT g AS group_name, w::BIGINT AS win_idx, n_sites, s, mean_n, round(p / n_sites, 6) AS theta_pi, round(s / list_sum(list_transform(range(1, greatest(2 * mean_n, 2)), lambda i: 1.0::DOUBLE / i)) / n_sites, 6) AS theta_w FROM w""")
def window_diversity(spark, d):
    return _rounded(stats.diversity(stats.frequencies(dosages(spark, d)), 50), 6, "theta_pi", "theta_w")


@query(f"""WITH {DOSAGES}, f AS (SELECT site, g, count(*) AS n, sum(x)::BIGINT AS alt FROM dos WHERE x >= 0 GROUP BY site, g),
b AS (SELECT a.g AS ga, b.g AS gb, a.site // 50 AS w, a.alt / (2 * a.n)::DOUBLE AS p, b.alt / (2 * b.n)::DOUBLE AS q, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.site = b.site AND a.g < b.g),
t AS (SELECT ga, gb, w, count(*) AS n, sum((p * (1 - q) + q * (1 - p))::DECIMAL(38,12))::DOUBLE AS d, sum(((p - q) * (p - q) - p * (1 - p) / greatest(2 * na - 1, 1) - q * (1 - q) / greatest(2 * nb - 1, 1))::DECIMAL(38,12))::DOUBLE AS f FROM b GROUP BY ALL)
SELECT ga AS group_a, gb AS group_b, w::BIGINT AS win_idx, n AS n_sites, round(d / n, 6) AS dxy, CASE WHEN d > 0 THEN round(f / d, 5) END AS fst FROM t""")
def window_divergence(spark, d):
    out = stats.divergence(stats.frequencies(dosages(spark, d)), 50)
    return _rounded(_rounded(out, 6, "dxy"), 5, "fst")


_R2 = f"""{DOSAGES}, p AS (SELECT a.g, a.site AS sa, b.site AS sb, count(*) AS n, sum(a.x)::BIGINT AS a, sum(b.x)::BIGINT AS b, sum(a.x * b.x)::BIGINT AS ab, sum(a.x * a.x)::BIGINT AS aa, sum(b.x * b.x)::BIGINT AS bb
FROM dos a JOIN dos b ON a.g = b.g AND a.sample = b.sample AND b.site > a.site AND b.site - a.site <= 5 GROUP BY ALL),
r AS (SELECT g, sa, sb, n, CASE WHEN (n * aa - a * a) * (n * bb - b * b) > 0 THEN ((n * ab - a * b) * (n * ab - a * b))::DOUBLE / ((n * aa - a * a) * (n * bb - b * b))::DOUBLE END AS r2 FROM p)"""


@query(f"WITH {_R2} SELECT g AS group_name, sa AS site_a, sb AS site_b, n, round(r2, 6) AS r2 FROM r")
def pair_correlations(spark, d):
    """Squared correlations of sites at most 5 apart, by an equi-join on bins."""
    return _rounded(stats.pair_r2(dosages(spark, d), 5), 6, "r2")


@query(f"""WITH {_R2}, k AS (SELECT *, ntile(10) OVER (PARTITION BY g ORDER BY sb - sa, sa) AS t FROM r WHERE r2 IS NOT NULL)
SELECT g AS group_name, count(*) AS n_pairs, round(quantile_cont(r2, 0.5), 5) AS median_r2, round(avg((r2 > 0.8)::INT), 6) AS share_above_08, {', '.join(f'round(quantile_cont(r2, 0.5) FILTER (t = {i}), 5) AS decay_{i}' for i in range(1, 11))} FROM k GROUP BY g""")
def ld_summary(spark, d):
    out = stats.ld_summary(stats.pair_r2(dosages(spark, d), 5))
    return _rounded(_rounded(out, 5, "median_r2", *(f"decay_{i}" for i in range(1, 11))), 6, "share_above_08")


_CELLS = """c AS (SELECT o_custkey, last(o_orderstatus ORDER BY o_orderkey) AS a, last(left(o_orderpriority, 1) ORDER BY o_orderkey) AS b FROM orders GROUP BY o_custkey),
k AS (SELECT CASE a WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END AS a, b FROM c WHERE b IN ('1', '2', '3')),
g AS (SELECT x.v AS a, y.v AS b FROM (VALUES ('1'), ('2'), ('3')) x(v), (VALUES ('1'), ('2'), ('3')) y(v)),
o AS (SELECT g.a, g.b, count(k.a) AS n FROM g LEFT JOIN k ON k.a = g.a AND k.b = g.b GROUP BY ALL),
e AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a)::BIGINT * sum(n) OVER (PARTITION BY b)::BIGINT / sum(n) OVER ()::DOUBLE AS x FROM o),
t AS (SELECT a AS call_a, b AS call_b, n AS observed, floor(x * 100 + 0.5) / 100 AS expected, CASE WHEN x > 0 THEN floor((n - x) * (n - x) / x * 1000.0::DOUBLE + 0.5) / 1000 ELSE 0 END AS chi_sq, x >= 5 AS cell_ok FROM e)"""


def _cells(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_orderpriority")
    a = o.select("sample", "seq", F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("3").alias("call"))
    b = o.select("sample", "seq", F.left("o_orderpriority", F.lit(1)).alias("call"))
    return stats.contingency(a, b, ["1", "2", "3"])


@query(f"WITH {_CELLS} SELECT call_a, call_b, observed, round(expected, 2) AS expected, round(chi_sq, 2) AS chi_sq, cell_ok FROM t")
def contingency_cells(spark, d):
    """The last call of each sample in two call sets, crossed."""
    return _rounded(_cells(spark, d), 2, "expected", "chi_sq")


@query(f"WITH {_CELLS} SELECT sum(observed)::BIGINT AS n_samples, round(sum(chi_sq::DECIMAL(38,3))::DOUBLE, 1) AS total_chi_sq, 4::BIGINT AS df, sum((NOT cell_ok)::INT)::BIGINT AS cells_below_min FROM t")
def contingency_total(spark, d):
    return _rounded(stats.contingency_totals(_cells(spark, d)), 1, "total_chi_sq")


@query(f"""WITH {DOSAGES}, t AS (SELECT s_suppkey AS t, s_suppkey AS o, s_suppkey - 1 AS p1, s_suppkey - 2 AS p2 FROM supplier)
SELECT t AS trio_id, count(*) AS n_sites, sum((o.x < (a.x = 2)::INT + (b.x = 2)::INT OR o.x > (a.x > 0)::INT + (b.x > 0)::INT)::INT)::BIGINT AS n_errors FROM t JOIN dos o ON o.sample = t.o JOIN dos a ON a.sample = t.p1 AND a.site = o.site JOIN dos b ON b.sample = t.p2 AND b.site = o.site GROUP BY t""")
def mendelian_errors(spark, d):
    s = table(spark, d, "supplier")
    trios = s.select(F.col("s_suppkey").alias("trio_id"), F.col("s_suppkey").alias("offspring"), (F.col("s_suppkey") - 1).alias("parent1"), (F.col("s_suppkey") - 2).alias("parent2"))
    return stats.mendel_errors(dosages(spark, d), trios).select("trio_id", "n_sites", "n_errors")


@query(f"""WITH {DOSAGES} SELECT a.sample AS a, b.sample AS b, count(*) AS n_sites, sum((abs(a.x - b.x) = 2)::INT)::BIGINT AS ibs0, sum((abs(a.x - b.x) = 1)::INT)::BIGINT AS ibs1, sum((a.x = b.x)::INT)::BIGINT AS ibs2,
CASE WHEN sum((a.x = 1)::INT) + sum((b.x = 1)::INT) > 0 THEN round((sum((a.x = 1 AND b.x = 1)::INT) - 2 * sum((abs(a.x - b.x) = 2)::INT))::DOUBLE / (sum((a.x = 1)::INT) + sum((b.x = 1)::INT))::DOUBLE, 6) END AS king
FROM dos a JOIN dos b ON a.site = b.site AND a.sample < b.sample GROUP BY ALL""")
def kinship(spark, d):
    return _rounded(stats.king(dosages(spark, d, by_site=True)), 6, "king")


@query("""WITH g AS (SELECT c_mktsegment AS g, sum(c_acctbal::DECIMAL(38,9)) AS t, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT sum(t) AS t, sum(n) AS n FROM g)
SELECT g.g AS c_mktsegment, round(CASE WHEN a.n > g.n THEN (a.t - g.t)::DOUBLE / (a.n - g.n) END, 4) AS without FROM g, a""")
def jackknife_means(spark, d):
    return _rounded(stats.jackknife(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"), 4, "without")


@query("""WITH j AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT sum(n * (n - 1) // 2)::DOUBLE AS ij, sum(n)::BIGINT AS n FROM j),
i AS (SELECT sum(n * (n - 1) // 2)::DOUBLE AS i FROM (SELECT sum(n)::BIGINT AS n FROM j GROUP BY a)), k AS (SELECT sum(n * (n - 1) // 2)::DOUBLE AS k FROM (SELECT sum(n)::BIGINT AS n FROM j GROUP BY b))
SELECT round((ij - i * k / (n * (n - 1) / 2)) / ((i + k) / 2 - i * k / (n * (n - 1) / 2)), 6) AS ari, n FROM x, i, k""")
def adjusted_rand_index(spark, d):
    return _rounded(stats.adjusted_rand(table(spark, d, "customer"), "c_mktsegment", "c_nationkey"), 6, "ari")


@query("""SELECT o_orderpriority, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS r, round(CASE WHEN count(*) > 0 THEN (count(*)::DOUBLE * sum((o_orderkey % 3) * (o_orderstatus = 'F')::INT)::DOUBLE - sum((o_orderstatus = 'F')::INT)::DOUBLE * sum(o_orderkey % 3)::DOUBLE) * sqrt(count(*)::DOUBLE)
/ sqrt(sum((o_orderstatus = 'F')::INT)::DOUBLE * (count(*) - sum((o_orderstatus = 'F')::INT))::DOUBLE * (count(*)::DOUBLE * sum((o_orderkey % 3) * (o_orderkey % 3))::DOUBLE - sum(o_orderkey % 3)::DOUBLE * sum(o_orderkey % 3)::DOUBLE)) END, 5) AS z FROM orders GROUP BY o_orderpriority""")
def armitage_trend(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3).alias("dosage"), (F.col("o_orderstatus") == "F").cast("int").alias("affected"))
    return _rounded(stats.armitage_trend(rows, "o_orderpriority"), 5, "z")


@query("""WITH t AS (SELECT l_shipmode_ AS k, sum((e = 1 AND f = 1)::INT)::BIGINT AS a, sum((e = 1 AND f = 0)::INT)::BIGINT AS b, sum((e = 0 AND f = 1)::INT)::BIGINT AS c, sum((e = 0 AND f = 0)::INT)::BIGINT AS d FROM (SELECT l_linenumber AS l_shipmode_, (l_discount > 0.05)::INT AS e, (l_returnflag = 'R')::INT AS f FROM lineitem) GROUP BY 1)
SELECT k AS l_linenumber, a, b, c, d, CASE WHEN b * c > 0 THEN round((a * d)::DOUBLE / (b * c)::DOUBLE, 6) END AS odds_ratio FROM t""")
def odds_ratios(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_discount") > 0.05).cast("int").alias("e"), (F.col("l_returnflag") == "R").cast("int").alias("f"))
    return _rounded(stats.odds_ratio(rows, "l_linenumber", "e", "f"), 6, "odds_ratio")


_SETS = "m AS (SELECT DISTINCT o_orderpriority AS s, o_custkey::VARCHAR AS m FROM orders)"


def _members(spark, d):
    """Sets of customers by the priority of their orders."""
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("set_id"), F.col("o_custkey").cast("string").alias("member"))


@query(f"WITH {_SETS} SELECT m AS member FROM m WHERE s = '1-URGENT' INTERSECT SELECT m FROM m WHERE s = '5-LOW'")
def set_intersection(spark, d):
    return sets.intersect_all(_members(spark, d), ["1-URGENT", "5-LOW"])


@query(f"WITH {_SETS} SELECT m AS member FROM m WHERE s = '1-URGENT' UNION SELECT m FROM m WHERE s = '5-LOW'")
def set_union(spark, d):
    return sets.union_all(_members(spark, d), ["1-URGENT", "5-LOW"])


@query(f"WITH {_SETS} SELECT m AS member FROM m WHERE s = '1-URGENT' EXCEPT SELECT m FROM m WHERE s IN ('5-LOW', '2-HIGH')")
def set_difference(spark, d):
    return sets.difference(_members(spark, d), "1-URGENT", ["5-LOW", "2-HIGH"])


@query(f"WITH {_SETS}, h AS (SELECT s, count(*) AS n, sha256(string_agg(m, chr(10) ORDER BY m) || chr(10)) AS h FROM m GROUP BY s) SELECT s AS set_id, n AS n_members, 'sha256:' || h AS members_hash, 'sset_' || left(h, 16) AS sample_set_id FROM h")
def set_identity(spark, d):
    """Ids that depend on the members alone."""
    return sets.set_ids(_members(spark, d))


_PARAMS = "'sha256:' || sha256('{\"k\":2,\"names\":[\"a\"]}')"


@query(f"""WITH {_SETS}, h AS (SELECT s, 'sset_' || left(sha256(string_agg(m, chr(10) ORDER BY m) || chr(10)), 16) AS i FROM m GROUP BY s), r AS (SELECT s, a, 'res_' || left(sha256(a || '|' || i || '|' || 'x,y' || '|' || {_PARAMS}), 16) AS id FROM h, (VALUES ('fst'), ('pi')) v(a))
SELECT s AS set_id, a AS analysis_id, id AS result_id, CASE WHEN id IN (SELECT id FROM r WHERE a = 'fst' AND s < '3') THEN 'cached' ELSE 'todo' END AS state FROM r""")
def result_plan(spark, d):
    """Requests whose result is stored already, told by content alone; artifacts come in any order and more than once."""
    ids = sets.set_ids(_members(spark, d)).select("set_id", "sample_set_id")
    requests = ids.select("*", F.explode(F.array(F.lit("fst"), F.lit("pi"))).alias("analysis_id")).withColumn("artifacts", F.array(F.lit("y"), F.lit("x"), F.lit("y"))).withColumn("params_hash", F.lit(sets.params_hash({"names": ["a"], "k": 2})))
    stored = sets.result_ids(requests.filter("analysis_id = 'fst' and set_id < '3'").withColumn("artifacts", F.array(F.lit("x"), F.lit("y"))))
    return sets.plan(requests, stored).select("set_id", "analysis_id", "result_id", "state")


@query("""SELECT o_orderkey, c_name, n_name, r_name, o_orderdate::DATE::VARCHAR AS created_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def inventory(spark, d):
    """Facts with their dimensions, left outer."""
    facts = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("created_at"))
    out = registry.enriched(facts, [(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", "o_custkey"), (table(spark, d, "nation"), "n_nationkey", "c_nationkey"), (table(spark, d, "region"), "r_regionkey", "n_regionkey")])
    return out.select("o_orderkey", "c_name", "n_name", "r_name", "created_at")


@query("""SELECT l_orderkey::VARCHAR || '-' || l_linenumber AS row_id, 'l_partkey' AS "column", l_partkey::VARCHAR AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)
UNION ALL SELECT l_orderkey::VARCHAR || '-' || l_linenumber, 'l_suppkey', l_suppkey::VARCHAR FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def reference_check(spark, d):
    """References that name nothing, for two columns."""
    rows = table(spark, d, "lineitem").withColumn("row_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return registry.missing_references(rows, "row_id", [("l_partkey", table(spark, d, "part").filter("p_size > 3"), "p_partkey"), ("l_suppkey", table(spark, d, "supplier").filter("s_acctbal > 0"), "s_suppkey")])


@query("""SELECT a AS member, 'unknown' AS kind FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT c_custkey, 'ungrouped' FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def membership_check(spark, d):
    group = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("member"))
    return registry.membership_gaps(group, table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("member")), "member")


@query("""WITH a AS (SELECT 'orphan_orders' AS c, o_orderkey::VARCHAR AS t FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), b AS (SELECT 'poor_customers' AS c, c_name AS t FROM customer WHERE c_acctbal < -900)
SELECT 'orphan_orders' AS "check", count(*) = 0 AS pass, count(*) AS n_violations, coalesce(array_to_string(list_sort(list(t))[1:5], '; '), '') AS details FROM a UNION ALL SELECT 'poor_customers', count(*) = 0, count(*), coalesce(array_to_string(list_sort(list(t))[1:5], '; '), '') FROM b""")
def integrity_report(spark, d):
    orphans = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    poor = table(spark, d, "customer").filter("c_acctbal < -900")
    return registry.check_report([("orphan_orders", orphans, F.col("o_orderkey")), ("poor_customers", poor, F.col("c_name"))])


@query("WITH p AS (SELECT p_type || ' ' || p_name || ' ' || p_partkey AS k, p_brand FROM part) SELECT k, CASE WHEN starts_with(lower(k), 'small') THEN 0 WHEN contains(lower(k), 'small') THEN 1 ELSE 2 END AS rank FROM p WHERE contains(lower(k || ' ' || p_brand), 'small') ORDER BY rank, k LIMIT 50")
def ranked_search(spark, d):
    """The first 50 hits, those whose name begins with the words first."""
    parts = table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_name", F.col("p_partkey").cast("string")).alias("k"), "p_brand")
    return registry.search(parts, "k", ["p_brand"], "Small").select("k", "rank")


@query("SELECT event_id, user_id, event_type, (SELECT count(*) FROM events) AS total FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 25")
def filtered_tail(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return registry.tail(rows, "event_id", 25, {"event_type": "click", "user_id": None})


_MODULES = "m AS (SELECT p_partkey AS m, 't' || p_partkey || ',u' || (p_partkey // 4) AS p, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 't' || (2 * p_partkey) || ', u' || (p_partkey // 8) END AS r FROM part)"


def _modules(spark, d):
    """Every part as a module: it makes a tag of its own and one that four parts make, and needs two, of which some nobody makes."""
    k = F.col("p_partkey")
    tag = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    return table(spark, d, "part").select(k.alias("module"), F.concat_ws(",", tag("t", k), tag("u", F.floor(k / 4))).alias("produces"), F.when(k % 3 == 0, "").otherwise(F.concat(tag("t", 2 * k), F.lit(", "), tag("u", F.floor(k / 8)))).alias("requires"))


@query(f"WITH {_MODULES} SELECT DISTINCT a.m AS producer, b.m AS consumer, t AS tag FROM (SELECT m, unnest(string_split(p, ',')) AS t FROM m) a JOIN (SELECT m, trim(unnest(string_split(r, ','))) AS u FROM m) b ON t = u WHERE t <> '' AND a.m <> b.m")
def module_lineage(spark, d):
    return registry.lineage(_modules(spark, d))


@query(f"WITH {_MODULES} SELECT DISTINCT m AS consumer, u AS tag FROM (SELECT m, trim(unnest(string_split(r, ','))) AS u FROM m) WHERE u <> '' AND u NOT IN (SELECT unnest(string_split(p, ',')) FROM m)")
def unproduced_inputs(spark, d):
    return registry.unproduced(_modules(spark, d))


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey AS s, o_orderpriority || o_orderdate::DATE AS c, o_totalprice AS t FROM orders), x AS (SELECT * FROM p WHERE t > 490000)
SELECT DISTINCT id AS product_id FROM p WHERE (s IN (SELECT s FROM x) OR c IN (SELECT c FROM x)) AND id NOT IN (SELECT id FROM x)""")
def nearby_products(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("sample_scope"), F.concat("o_orderpriority", F.col("o_orderdate").cast("date").cast("string")).alias("coordinate_scope"), "o_totalprice")
    return registry.nearby(p, p.filter("o_totalprice > 490000"))


@query("""WITH q AS (SELECT o_custkey AS q, list_sort(list_distinct(list(o_orderpriority))) AS r FROM orders GROUP BY 1) SELECT q AS question_id, array_to_string(list_filter(r, lambda x: x IN ('1-URGENT', '5-LOW')), ',') AS matched FROM q WHERE list_has_any(r, ['1-URGENT', '5-LOW'])""")
def answerable_questions(spark, d):
    q = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("question_id")).agg(F.collect_set("o_orderpriority").alias("requires"))
    return registry.answerable(q, ["1-URGENT", "5-LOW"]).select("question_id", F.array_join("matched", ",").alias("matched"))


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn AS s, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
w AS (SELECT conv_id, s AS root, t AS pos, 1 AS depth FROM e WHERE t IS NOT NULL AND s NOT IN (SELECT t FROM e x WHERE x.conv_id = e.conv_id AND t IS NOT NULL) UNION ALL SELECT w.conv_id, root, e.t, depth + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.s = w.pos WHERE e.t IS NOT NULL)
SELECT conv_id || ':' || root AS root, conv_id || ':' || max(pos) AS leaf, max(depth)::INT AS depth FROM w GROUP BY conv_id, root""")
def dependency_chains(spark, d):
    """Paths from roots to leaves; here each conversation is one chain of turns."""
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    name = lambda c: F.concat_ws(":", F.col("conv_id").cast("string"), F.col(c).cast("string"))
    nxt = turns.withColumn("next", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    return graph.chains(nxt.select(name("turn").alias("src"), name("next").alias("dst"))).select("root", "leaf", "depth")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS s, t FROM part, (SELECT unnest([2, 3]) AS k) LEFT JOIN LATERAL (SELECT p_partkey // k AS t) ON true WHERE t > 0 AND t <> p_partkey), w AS (SELECT DISTINCT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part UNION SELECT start, e.t, depth + 1 FROM w JOIN e ON e.s = w.node)
SELECT start, node, max(depth)::INT AS depth FROM w GROUP BY start, node""")
def prerequisites(spark, d):
    """Everything that a node needs, at its greatest distance."""
    k = F.explode(F.array(F.lit(2), F.lit(3)))
    edges = table(spark, d, "part").select(F.col("p_partkey").alias("src"), k.alias("k")).select("src", F.floor(F.col("src") / F.col("k")).alias("dst")).filter("dst > 0 and dst <> src").distinct()
    starts = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return graph.closure(edges, starts)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN k % 23 = 5 THEN CASE WHEN k % 2 = 0 THEN 'RESOLVED' ELSE 'KNOWN_MISSING' END WHEN k % 29 = 7 OR k % 13 = 7 THEN 'UNKNOWN_CONTRACT' WHEN k % 5 = 0 THEN 'COMPLETE' WHEN k % 17 = 3 THEN 'FAILED' END AS f FROM part),
s AS (SELECT 0 AS i, (SELECT list(f ORDER BY k) FROM p) AS st UNION ALL SELECT i + 1, list_transform(range(len(st)), lambda k: coalesce(st[k + 1], CASE
  WHEN (k // 2 > 0 AND st[k // 2 + 1] IN ('KNOWN_MISSING', 'BLOCKED_BY_INPUT', 'FAILED', 'UNKNOWN_CONTRACT')) OR (k // 3 > 0 AND st[k // 3 + 1] IN ('KNOWN_MISSING', 'BLOCKED_BY_INPUT', 'FAILED', 'UNKNOWN_CONTRACT')) THEN 'BLOCKED_BY_INPUT'
  WHEN (k // 2 > 0 AND st[k // 2 + 1] IS NULL) OR (k // 3 > 0 AND st[k // 3 + 1] IS NULL) THEN NULL
  WHEN (k // 2 = 0 OR st[k // 2 + 1] IN ('RESOLVED', 'COMPLETE')) AND (k // 3 = 0 OR st[k // 3 + 1] IN ('RESOLVED', 'COMPLETE')) THEN 'READY_TO_RUN' ELSE 'KNOWN_MISSING' END)) FROM s WHERE i < 40)
SELECT (unnest(range(len(st))))::BIGINT AS layer, unnest(st) AS state FROM s WHERE i = 40""")
def layer_readiness(spark, d):
    """States of layers to a fixpoint; needs go to half and a third of a layer's number."""
    k = F.col("p_partkey")
    kind = F.when(k % 23 == 5, "file").when(k % 29 == 7, "other").otherwise("analysis_result")
    layers = table(spark, d, "part").select(k.alias("layer"), kind.alias("source_kind"), (k % 2 == 0).alias("present"), F.when(k % 5 == 0, "active").when(k % 17 == 3, "failed").alias("result"), (k % 13 != 7).alias("has_producer"))
    needs = table(spark, d, "part").select(k.alias("layer"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("input")).filter("input > 0 and input <> layer")
    return graph.layer_states(layers, needs)


@query("""WITH r AS (SELECT o_custkey AS q, count(*) FILTER (o_orderstatus = 'P') AS n, min(o_orderkey) FILTER (o_orderstatus = 'P') AS id FROM orders GROUP BY 1) SELECT q AS request, CASE WHEN n = 1 THEN 'ok' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS match FROM r""")
def contract_resolution(spark, d):
    o = table(spark, d, "orders")
    requests = o.select(F.col("o_custkey").alias("request")).distinct().withColumn("o_custkey", F.col("request"))
    return graph.unique_match(requests, o.filter("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("row_id")), ["o_custkey"])


@query("SELECT user_id, event_type, last(event_id ORDER BY ts, event_id) AS event_id, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_entries(spark, d):
    """The last entry of each key of an append-only log."""
    return log.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("WITH r AS (SELECT event_id, (event_id % 1000)::BIGINT AS b, sum((event_id % 1000)::BIGINT) OVER (ORDER BY ts::DATE DESC, ts DESC, event_id) AS running FROM events) SELECT event_id AS entry, running::BIGINT AS running, running <= 100000 AS kept FROM r")
def cache_eviction(spark, d):
    """Which entries a byte budget keeps, the most recently used first."""
    e = table(spark, d, "events").select(F.col("event_id").alias("entry"), (F.col("event_id") % 1000).alias("bytes"), F.col("ts").alias("used_at"))
    return log.evicted(e, 100_000).select("entry", "running", "kept")


@query("SELECT event_id AS request_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) > 3600 * 1000000::BIGINT, true) AS leader FROM events")
def in_flight_dedupe(spark, d):
    e = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").alias("request_id"))
    return log.dedupe_in_flight(e, 3600).select("request_id", "leader")


_RUNS = "t AS (SELECT user_id, event_type AS st, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT user_id, st, i, sum(o) OVER (PARTITION BY user_id ORDER BY i) AS g FROM t), r AS (SELECT user_id, g::BIGINT AS g, st, count(*) AS n, min(i) AS a, max(i) AS b FROM s GROUP BY ALL)"


@query(f"WITH {_RUNS} SELECT user_id, g AS segment, st AS event_type, n, a::BIGINT AS first_place, b::BIGINT AS last_place FROM r")
def regime_segments(spark, d):
    s = intervals.segments(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return s.select("user_id", "segment", "event_type", "n", F.col("first_place").cast("long").alias("first_place"), F.col("last_place").cast("long").alias("last_place"))


@query(f"""WITH {_RUNS}, w AS (SELECT user_id, st, sum(n)::BIGINT AS w FROM r GROUP BY ALL), d AS (SELECT user_id, first(st ORDER BY w DESC, st) AS dom, sum(w)::BIGINT AS t, max(w) AS m FROM w GROUP BY user_id), a AS (SELECT r.user_id, max(n) * 20000 AS l FROM r JOIN d USING (user_id) WHERE st <> dom GROUP BY r.user_id)
SELECT user_id, dom AS dominant, round(1 - m / t::DOUBLE, 6) AS deviation, coalesce(l, 0)::BIGINT AS longest_bp, (1 - m / t::DOUBLE >= 0.15 AND coalesce(l, 0) >= 50000) AS fires FROM d LEFT JOIN a USING (user_id)""")
def recombinant_gate(spark, d):
    s = intervals.segments(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").withColumnRenamed("event_type", "state")
    return _rounded(rules.recombinant_gate(s, "user_id", 20_000), 6, "deviation")


@query("""WITH s AS (SELECT user_id, event_type AS l, coalesce((lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type)::INT, 0) AS s FROM events), c AS (SELECT user_id, l, count(*) AS n, sum(s) AS s FROM s GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n, sum(s)::BIGINT AS switches, count(*) AS n_labels, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 5) AS entropy FROM c GROUP BY user_id""")
def label_entropy(spark, d):
    return _rounded(rules.label_stats(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type"), 5, "entropy")


_EAV = "k AS (SELECT o_custkey AS c, 'q' || (1 + o_orderkey % 7) || '_' || o_orderstatus AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'not_applicable' WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_orderpriority END AS v FROM orders)"


@query(f"WITH {_EAV} SELECT c AS candidate_id, left(k, 2) AS question, count(*) AS total, sum((v IS NOT NULL AND v NOT IN ('', 'not_applicable'))::INT)::BIGINT AS resolved, CASE WHEN count(*) > count(*) FILTER (v = 'not_applicable') THEN round(sum((v IS NOT NULL AND v NOT IN ('', 'not_applicable'))::INT) * 100.0::DOUBLE / (count(*) - count(*) FILTER (v = 'not_applicable')), 4) END AS percent FROM k GROUP BY 1, 2")
def evidence_completion(spark, d):
    o = F.col("o_orderkey")
    value = F.when(o % 5 == 0, "not_applicable").when(o % 5 == 1, "").when(o % 5 == 2, None).otherwise(F.col("o_orderpriority"))
    k = table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.concat(F.lit("q"), (1 + o % 7).cast("string"), F.lit("_"), "o_orderstatus").alias("key"), value.alias("value"))
    return _rounded(rules.completion(k), 4, "percent")


@query("""WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS a, p_size % 3 > 0 AS b, p_size % 5 < 3 AS c, p_size % 7 < 4 AS d, p_size % 5 < 4 AS ct, p_size % 7 < 6 AS dt, p_size % 3 AS callers, p_size % 8 AS dims, p_size / 50.0 AS f FROM part)
SELECT p_partkey, CASE WHEN b AND NOT a AND NOT c AND callers >= 2 THEN 'SV-1' WHEN b AND NOT a AND NOT c THEN 'SV-2' WHEN a AND b AND c AND d THEN '1' WHEN a AND b AND d AND NOT ct THEN '1' WHEN a AND c AND NOT b AND NOT dt THEN '2' WHEN a AND b AND ((dt AND NOT d) OR NOT ct) THEN '2' WHEN (a OR b OR c) AND dims >= 4 THEN '3' ELSE '4' END AS tier,
CASE WHEN f < 0.05 THEN 'rare' WHEN f < 0.15 THEN 'low' WHEN f < 0.5 THEN 'intermediate' WHEN f < 0.85 THEN 'high' ELSE 'nearly_fixed' END AS band FROM p""")
def evidence_tiers(spark, d):
    """Tiers by pathway: which layers were tested and passed, callers of layer B, positive dimensions of D."""
    s = F.col("p_size")
    passed = {"a": s % 2 == 0, "b": s % 3 > 0, "c": s % 5 < 3, "d": s % 7 < 4}
    return table(spark, d, "part").select("p_partkey", rules.confidence_tier(**passed, c_tested=s % 5 < 4, d_tested=s % 7 < 6, callers=s % 3, dimensions=s % 8).alias("tier"), rules.frequency_band(s / 50).alias("band"))


@query("SELECT l_orderkey AS candidate, l_suppkey AS sample, count(DISTINCT l_linenumber) AS n_sources, count(DISTINCT l_returnflag) AS n_calls, count(DISTINCT l_returnflag) = 1 AS agrees FROM lineitem GROUP BY 1, 2")
def carrier_agreement(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("source"), F.col("l_returnflag").alias("call"))
    return stats.agreement(calls)


@query("SELECT c_custkey, ntile(3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)::INT AS third, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 6) AS rank_share FROM customer")
def rank_thirds(spark, d):
    return _rounded(rules.thirds(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey").select("c_custkey", "third", "rank_share"), 6, "rank_share")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL")
def json_projection(spark, d):
    """A key of nested JSON as a typed column."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").select("event_id", k.alias("k")).filter("k is not null")


@query("SELECT n_nationkey, 'C_' || n_name || ':' || replace(format('{:,}', n_nationkey * 12345), ',', '_') || '-' || replace(format('{:,}', n_nationkey * 12345 + 1000000), ',', '_') AS label FROM nation")
def interval_labels(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", scalars.interval_label(F.concat(F.lit("C_"), "n_name"), n * 12345, n * 12345 + 1000000).alias("label"))


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(*) AS customers, array_to_string(list_sort(list_distinct(list(c_nationkey::VARCHAR))), ',') AS listed FROM customer GROUP BY 1")
def facets(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.count("*").alias("customers"), sets.csv_list(F.collect_set(F.col("c_nationkey").cast("string"))).alias("listed"))


@query(f"""WITH {DOSAGES}, f AS (SELECT site, g, count(*) AS n, sum(x)::BIGINT AS alt FROM dos WHERE x >= 0 GROUP BY site, g), p AS (SELECT site // 200 AS w, g, CASE WHEN site % 3 = 0 THEN 'N' ELSE 'S' END AS c, (2 * alt * (2 * n - alt) / (2 * n * (2 * n - 1))::DOUBLE)::DECIMAL(38,12) AS pi FROM f),
t AS (SELECT g, w, sum(pi) FILTER (c = 'N')::DOUBLE / count(*) FILTER (c = 'N') AS a, sum(pi) FILTER (c = 'S')::DOUBLE / count(*) FILTER (c = 'S') AS b FROM p GROUP BY ALL)
SELECT g AS group_name, w::BIGINT AS win_idx, round(a, 6) AS pi_n, round(b, 6) AS pi_s, CASE WHEN b > 0 THEN round(a / b, 5) END AS ratio FROM t""")
def class_diversity(spark, d):
    classes = table(spark, d, "part").select(F.col("p_partkey").alias("site"), F.when(F.col("p_partkey") % 3 == 0, "N").otherwise("S").alias("class"))
    return _rounded(_rounded(stats.pi_by_class(stats.frequencies(dosages(spark, d)), classes, 200), 6, "pi_n", "pi_s"), 5, "ratio")


@query("SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n_windows, sum(l_extendedprice::DECIMAL(38,9))::DOUBLE / count(*) AS mean, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL")
def windows_summarised(spark, d):
    return stats.window_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) < 0.05 AS fallback, CASE WHEN greatest(l_discount, l_tax) >= 0.05 THEN CASE WHEN l_discount = greatest(l_discount, l_tax) THEN 'l_discount' ELSE 'l_tax' END END AS \"group\" FROM lineitem")
def dominant_groups(spark, d):
    """Each row's group by its greatest share, with a fallback."""
    return stats.dominant_component(table(spark, d, "lineitem"), ["l_discount", "l_tax"], 0.05).select("l_orderkey", "l_linenumber", "fallback", "group")


@query("SELECT o_orderpriority, count(*) AS n, round(regr_slope(o_totalprice, o_orderkey), 4) AS beta, round(regr_r2(o_totalprice, o_orderkey), 6) AS r2 FROM orders GROUP BY 1")
def burden_regression(spark, d):
    out = stats.burden(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice")
    return _rounded(_rounded(out.select("o_orderpriority", "n", "beta", "r2"), 4, "beta"), 6, "r2")


@query("WITH c AS (SELECT l_orderkey AS p, l_linenumber AS d, l_discount * 10 AS c FROM lineitem), f AS (SELECT *, first_value(c) OVER (PARTITION BY p ORDER BY d) - c > 0.3 AS fell FROM (SELECT p, d, max(c) AS c FROM c GROUP BY ALL)) SELECT d AS distance, round(sum(c::DECIMAL(38,9))::DOUBLE / count(*), 6) AS mean, sum((c > 0.8)::INT)::BIGINT AS above_08, sum(fell::INT)::BIGINT AS decayed FROM f GROUP BY d")
def concordance_by_distance(spark, d):
    calls = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("distance")).agg(F.max(F.col("l_discount") * 10).alias("concordance"))
    return _rounded(stats.distance_concordance(calls), 6, "mean")


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, lag(o_orderkey) OVER w AS b, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), u AS (SELECT a, b FROM e WHERE d <= 90 UNION SELECT b, a FROM e WHERE d <= 90),
r AS (SELECT a AS n, a AS m FROM u UNION SELECT r.n, u.b FROM r JOIN u ON u.a = r.m) SELECT n AS node, min(m) AS root FROM r GROUP BY n""")
def kin_groups(spark, d):
    """Components of a threshold graph, as pedigrees are joined from related pairs: here a customer's orders at most 90 days apart."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.datediff("o_orderdate", F.lag("o_orderdate").over(w))
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(w).alias("b"), days.alias("days"))
    return graph.components(e.filter("days <= 90").select("a", "b"))


_QUESTIONS = """q AS (SELECT DISTINCT l_orderkey AS q, 'p' || l_partkey AS p, l_linenumber > 1 AS r FROM lineitem),
s AS (SELECT 'p' || p_partkey AS p, ['ready', 'available', 'missing', 'stale', 'ready', 'validated', 'blocked', 'deprecated', 'rejected'][p_size % 9 + 1] AS s, CASE WHEN p_size % 4 > 0 THEN 'm' || (p_partkey // 16) END AS m FROM part WHERE p_size > 3)"""


def _questions(spark, d):
    """Orders ask for parts, all but their first line's; parts of size 3 and less are unknown."""
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product"), (F.col("l_linenumber") > 1).alias("required")).distinct()
    names = F.array(*map(F.lit, ("ready", "available", "missing", "stale", "ready", "validated", "blocked", "deprecated", "rejected")))
    parts = table(spark, d, "part").filter("p_size > 3")
    producer = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 16).cast("string")))
    return q, parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("product"), F.get(names, F.col("p_size") % 9).alias("state"), producer.alias("producer"))


@query(f"""WITH {_QUESTIONS}, j AS (SELECT q.q, q.p, coalesce(s.s, 'missing') AS s FROM q LEFT JOIN s ON q.p = s.p WHERE q.r), a AS (SELECT q, bool_and(s = 'ready') AS ok, bool_or(s IN ('missing', 'blocked', 'deprecated')) AS bad, bool_or(s IN ('ready', 'validated', 'available')) AS good, list_sort(list_distinct(list(CASE WHEN s IN ('missing', 'blocked') THEN p END))) AS m FROM j GROUP BY q)
SELECT x.q AS question, CASE WHEN coalesce(ok, true) THEN 'ready_to_run' WHEN bad AND NOT good THEN 'blocked' ELSE 'partial' END AS state, coalesce(array_to_string(m, ','), '') AS missing FROM (SELECT DISTINCT q FROM q) x LEFT JOIN a ON a.q = x.q""")
def question_readiness(spark, d):
    q, s = _questions(spark, d)
    return graph.question_states(q, s).withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH {_QUESTIONS}, j AS (SELECT DISTINCT q.q, q.p, s.m FROM q LEFT JOIN s ON q.p = s.p WHERE q.r AND coalesce(s.s, 'missing') IN ('missing', 'blocked'))
SELECT q AS question, p AS product, CASE WHEN m IS NULL THEN 'register_producer' ELSE 'run' END AS action, m AS analysis_id, CASE WHEN m IS NULL THEN 'Register a producing analysis for ' || p ELSE 'Run ' || m || ' to produce ' || p END AS label FROM j""")
def next_actions(spark, d):
    """What to run, or to register, for each required product that is missing or blocked."""
    q, s = _questions(spark, d)
    return graph.next_actions(q, s.select("product", "state"), s.select("product", "producer"))


@query(f"WITH {_QUESTIONS}, w AS (SELECT DISTINCT q.p, s.m FROM q JOIN s ON q.p = s.p WHERE r AND s.s IN ('missing', 'blocked') AND s.m IS NOT NULL) SELECT m AS producer, array_to_string(list_sort(list(p)), ',') AS products FROM w GROUP BY 1")
def dispatch_plan(spark, d):
    q, s = _questions(spark, d)
    return graph.dispatch(q, s.select("product", "state"), s.filter("producer is not null").select("product", "producer")).withColumn("products", F.array_join("products", ","))


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 31 = 5 THEN 999999 WHEN p_partkey % 50 = 1 THEN p_partkey + 1 WHEN p_partkey % 50 = 2 THEN p_partkey - 1 ELSE p_partkey // 2 END AS nx FROM part),
w AS (SELECT id, nx AS pos, [id] AS seen FROM r WHERE nx IS NOT NULL UNION ALL SELECT w.id, r.nx, list_append(w.seen, w.pos) FROM w JOIN r ON r.id = w.pos WHERE NOT list_contains(w.seen, w.pos) AND r.nx IS NOT NULL)
SELECT DISTINCT id::VARCHAR AS result_id, CASE WHEN list_contains(seen, pos) THEN 'cycle' ELSE 'missing' END AS problem FROM w WHERE list_contains(seen, pos) OR pos NOT IN (SELECT id FROM r)""")
def result_chains(spark, d):
    """Results whose upstream chain breaks off or comes back."""
    k = F.col("p_partkey")
    nxt = F.when(k % 9 == 0, "").when(k % 31 == 5, "999999").when(k % 50 == 1, (k + 1).cast("string")).when(k % 50 == 2, (k - 1).cast("string")).otherwise(F.floor(k / 2).cast("string"))
    r = table(spark, d, "part").select(k.cast("string").alias("result_id"), nxt.alias("input_result_id"))
    return graph.upstream_problems(r)


@query(f"""WITH {_EAV}, t(q, k, b) AS (VALUES ('q1', 'q1_F', '1-URGENT'), ('q1', 'q1_O', '5-LOW'), ('q2', 'q2_F', '3-MEDIUM')), e AS (SELECT c, k, max(v) AS v FROM k GROUP BY c, k),
a AS (SELECT e.c, t.q, sum((e.v = t.b)::INT) AS pro FROM t JOIN e ON e.k = t.k WHERE coalesce(e.v, '') <> '' GROUP BY ALL), g AS (SELECT c, q, n FROM (SELECT DISTINCT c FROM e), (SELECT q, count(*) AS n FROM t GROUP BY q))
SELECT g.c AS candidate_id, g.q AS question, CASE WHEN pro IS NULL THEN 'EMPTY' WHEN pro >= n THEN 'ANSWERED' WHEN pro > 0 THEN 'PARTIAL' ELSE 'MEASURED' END AS state FROM g LEFT JOIN a ON a.c = g.c AND a.q = g.q""")
def characterisation(spark, d):
    """States of questions under a rule table over evidence keys."""
    o = F.col("o_orderkey")
    value = F.when(o % 5 == 0, "not_applicable").when(o % 5 == 1, "").when(o % 5 == 2, None).otherwise(F.col("o_orderpriority"))
    k = table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.concat(F.lit("q"), (1 + o % 7).cast("string"), F.lit("_"), "o_orderstatus").alias("key"), value.alias("value")).groupBy("candidate_id", "key").agg(F.max("value").alias("value"))
    rule = spark.createDataFrame([("q1", "q1_F", "eq", "1-URGENT", 1), ("q1", "q1_O", "eq", "5-LOW", 1), ("q2", "q2_F", "eq", "3-MEDIUM", 1)], "question string, key string, op string, bound string, weight int")
    return rules.characterised(k, rule)


_RESULTS = "r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 31 = 5 THEN 999999999 WHEN p_partkey % 50 = 1 THEN p_partkey + 1 WHEN p_partkey % 50 = 2 THEN p_partkey - 1 WHEN p_partkey % 4 = 3 THEN p_partkey - 1 ELSE p_partkey // 2 END AS nx FROM part)"


def _results(spark, d):
    k = F.col("p_partkey")
    nxt = F.when(k % 9 == 0, F.lit("")).when(k % 31 == 5, F.lit("999999999")).when(k % 50 == 1, (k + 1).cast("string")).when(k % 50 == 2, (k - 1).cast("string")).when(k % 4 == 3, (k - 1).cast("string")).otherwise(F.floor(k / 2).cast("string"))
    return table(spark, d, "part").select(k.cast("string").alias("result_id"), nxt.alias("input_result_id"))


@query(f"""WITH RECURSIVE {_RESULTS}, w AS (SELECT id AS root, id AS pos, 0::BIGINT AS depth FROM r WHERE nx IS NULL UNION ALL SELECT root, r.id, depth + 1 FROM w JOIN r ON r.nx = w.pos)
SELECT root::VARCHAR AS root, pos::VARCHAR AS leaf, depth FROM w WHERE pos NOT IN (SELECT nx FROM r WHERE nx IS NOT NULL)""")
def result_chain_ends(spark, d):
    """Roots and leaves of all chains of results; those that stand alone too, nothing behind an unknown input or a cycle."""
    return graph.chain_ends(_results(spark, d))


@query(f"""WITH RECURSIVE {_RESULTS}, w AS (SELECT id AS pos, [id] AS path FROM r WHERE nx IS NULL UNION ALL SELECT r.id, list_append(path, r.id) FROM w JOIN r ON r.nx = w.pos),
ended AS (SELECT pos, path FROM w WHERE pos NOT IN (SELECT nx FROM r WHERE nx IS NOT NULL))
SELECT pos::VARCHAR AS leaf, k AS place, path[k + 1]::VARCHAR AS result_id FROM ended, unnest(range(0, len(path))) t(k)""")
def result_chain_members(spark, d):
    """The results of every chain, root first."""
    return graph.chain_members(_results(spark, d))
