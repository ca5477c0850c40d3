"""Leaderboards, rankings and profiles over order lines (order = match, supplier or customer = participant, part = arena)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import aggs, joins, ranks, windows
from arenaflow.plans.registry import Tables, query


@query("""
SELECT s.s_suppkey AS suppkey, s.s_name AS name, count(*) AS matches, round(avg(l_extendedprice / nullif(l_quantity, 0)), 4) AS mean_ratio,
  round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS ratio_of_sums
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
WHERE o.o_orderstatus <> 'P' GROUP BY ALL HAVING count(*) >= 5
""")
def leaderboard(t: Tables):
    """Join, ratio metrics both ways (mean of ratios, ratio of sums), least number of matches."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey")
    per = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("l_suppkey").agg(
        F.count("*").alias("matches"), F.round(F.avg(F.try_divide("l_extendedprice", "l_quantity")), 4).alias("mean_ratio"),
        F.round(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")), 4).alias("ratio_of_sums"),
    ).filter("matches >= 5")
    names = t.supplier.select("s_suppkey", F.col("s_name").alias("name"))
    return per.join(names, per.l_suppkey == names.s_suppkey, "left").select(F.col("s_suppkey").alias("suppkey"), "name", "matches", "mean_ratio", "ratio_of_sums")


@query("""
WITH s AS (SELECT l_suppkey AS suppkey, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1),
u AS (SELECT suppkey, 'discount' AS stat, discount AS value, -discount AS k FROM s UNION ALL SELECT suppkey, 'tax', tax, tax FROM s UNION ALL SELECT suppkey, 'n', n, -n FROM s)
SELECT suppkey, stat, value, CAST(row_number() OVER (PARTITION BY stat ORDER BY k, suppkey) AS INTEGER) AS place FROM u QUALIFY place <= 10
""")
def unpivot_topn(t: Tables):
    """Top ten of several statistics from one aggregate, each with its own direction."""
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"), F.count("*").alias("n"))
    return windows.top_each(s, {"discount": "desc", "tax": "asc", "n": "desc"}, "suppkey", 10)


@query("SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS place, count(*) OVER (PARTITION BY c_nationkey) AS of FROM customer")
def rank_count_greater(t: Tables):
    """Rank as the number of strictly greater ones plus 1, with the population's size."""
    placed = ranks.ranked(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal")
    return placed.select("c_custkey", "c_nationkey", F.col("place").cast("int").alias("place"), "of")


@query("""
WITH g AS (SELECT o_custkey AS custkey, count(*) AS games, stddev_pop(o_totalprice) AS sd, avg(o_totalprice) AS mu FROM orders GROUP BY 1),
p AS (SELECT *, (sd > 120000 OR games < 10) AS provisional FROM g)
SELECT custkey, games, provisional, CASE WHEN NOT provisional THEN CAST(sum(CASE WHEN provisional THEN 0 ELSE 1 END) OVER (ORDER BY mu DESC, custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS place FROM p
""")
def cond_rank_provisional(t: Tables):
    """Provisional participants stay in the list without a place."""
    g = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("games"), F.stddev_pop("o_totalprice").alias("sd"), aggs.exact_mean("o_totalprice").alias("mu"))
    g = g.withColumn("provisional", (F.col("sd") > 120000) | (F.col("games") < 10))
    placed = windows.conditional_rank(g.withColumn("down", -F.col("mu")), "down", ["custkey"], F.col("provisional"))
    return placed.select("custkey", "games", "provisional", "place")


@query("""
WITH g AS (SELECT o_custkey AS custkey, avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sigma, max(CAST(o_orderdate AS DATE)) AS seen FROM orders GROUP BY 1)
SELECT custkey, CAST(date_diff('day', seen, DATE '2001-08-01') AS INTEGER) AS idle,
  round(sqrt(sigma * sigma + power(0.5 * greatest(0.0, date_diff('day', seen, DATE '2001-08-01') - 30), 2)), 4) AS sigma_now FROM g
""")
def decayed_sigma_rank(t: Tables):
    """Uncertainty after idle days."""
    g = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.stddev_pop("o_totalprice").alias("sigma"), F.max(F.to_date("o_orderdate")).alias("seen"))
    idle = F.datediff(F.lit("2001-08-01").cast("date"), "seen")
    return g.select("custkey", idle.alias("idle"), F.round(X.decayed_sigma("sigma", idle), 4).alias("sigma_now"))


@query("""
WITH s AS (SELECT o_custkey AS custkey, avg(o_totalprice) AS mu FROM orders GROUP BY 1), n AS (SELECT count(*) AS n FROM s),
o AS (SELECT mu, row_number() OVER (ORDER BY mu) - 1 AS place FROM s)
SELECT share, round(mu, 4) AS cutoff FROM o, n, (VALUES (0.95::DOUBLE), (0.8::DOUBLE), (0.5::DOUBLE), (0.2::DOUBLE)) v(share) WHERE n >= 10 AND place = floor(share * n)
""")
def tier_cutoffs(t: Tables):
    """Population cut-offs at the places int(p * n)."""
    s = t.orders.groupBy("o_custkey").agg(aggs.exact_mean("o_totalprice").alias("mu"))
    return aggs.cutoffs(s, "mu", X.TIER_SHARES).select("share", F.round("cutoff", 4).alias("cutoff"))


@query("""
WITH s AS (SELECT o_custkey AS custkey, avg(o_totalprice) AS mu FROM orders GROUP BY 1), n AS (SELECT count(*) AS n FROM s),
o AS (SELECT mu, row_number() OVER (ORDER BY mu) - 1 AS place FROM s),
k AS (SELECT share, mu AS cutoff FROM o, n, (VALUES (0.95::DOUBLE), (0.8::DOUBLE), (0.5::DOUBLE), (0.2::DOUBLE)) v(share) WHERE place = floor(share * n))
SELECT 1 + (SELECT count(*) FROM k WHERE k.cutoff > s.mu) AS tier, count(*) AS n FROM s GROUP BY 1
""")
def tier_hist(t: Tables):
    """How many fall into each tier."""
    s = t.orders.groupBy("o_custkey").agg(aggs.exact_mean("o_totalprice").alias("mu"))
    k = aggs.cutoffs(s, "mu", X.TIER_SHARES).agg(F.array_sort(F.collect_list("cutoff")).alias("cuts"))
    above = F.size(F.filter("cuts", lambda x: x > F.col("mu")))
    return s.join(F.broadcast(k)).groupBy((above + 1).cast("long").alias("tier")).agg(F.count("*").alias("n"))  # one row


@query("""
WITH g AS (SELECT l_suppkey AS suppkey, count(*) AS n, avg(l_discount) AS x FROM lineitem GROUP BY 1), m AS (SELECT avg(x) AS mean FROM g),
h AS (SELECT suppkey, x, (n * x + 150 * mean) / (n + 150) AS shrunk FROM g, m)
SELECT suppkey, round(shrunk, 9) AS shrunk, CAST(floor(99.0 * (SELECT count(*) FROM h b WHERE round(b.x, 9) < round(a.shrunk, 9)) / ((SELECT count(*) FROM h) - 1)) AS BIGINT) AS rating FROM h a
""")
def pctl_rank_shrunk(t: Tables):
    """Shrink to the mean, then the place of the shrunk value among the raw ones, 0 to 99: both are sorted once together."""
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("x"))
    m = g.agg(F.avg("x").alias("mean"), F.count("*").alias("all"))
    h = g.join(F.broadcast(m)).withColumn("shrunk", F.round(X.shrunk_to_mean("x", "n", "mean"), 9))  # one row
    raw = h.select(F.round("x", 9).alias("v"), F.lit(1).alias("own"), F.lit(None).cast("long").alias("suppkey"), "all")
    both = raw.unionByName(h.select(F.col("shrunk").alias("v"), F.lit(0).alias("own"), "suppkey", "all"))
    # ties: at equal values a shrunk one comes first, so that it counts only smaller raw ones
    summed = windows.running_sum(both, "v", ["own"], F.col("own"), "below")
    return summed.filter("own = 0").select("suppkey", F.col("v").alias("shrunk"), F.floor(99.0 * F.col("below") / (F.col("all") - 1)).alias("rating"))


@query("""
WITH w AS (SELECT *, count(*) OVER () AS all_n FROM (SELECT isoyear(o_orderdate) AS y, week(o_orderdate) AS w, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS v FROM orders) )
SELECT s AS status, p AS priority, CASE WHEN grouping(y) = 0 THEN printf('%d-%02d', y, w) END AS week, CAST(grouping(s) * 4 + grouping(p) * 2 + grouping(y) AS BIGINT) AS gid, count(*) AS n, round(avg(v), 4) AS mean
FROM w GROUP BY GROUPING SETS ((s), (p), (y, w), ())
""")
def metric_rollup_sets(t: Tables):
    """One scan grouped several ways."""
    o = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), X.iso_week("o_orderdate").alias("week"), F.col("o_totalprice").alias("v"))
    sets = o.groupingSets([[F.col("status")], [F.col("priority")], [F.col("week")], []], "status", "priority", "week")
    return sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("""
WITH p AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS meetings, count(*) FILTER (a.q > b.q) AS wins_a, count(*) FILTER (a.q < b.q) AS wins_b, sum(a.q - b.q) AS margin
FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2
""")
def pair_self_join(t: Tables):
    """Pairs of participants of a match after one row for each was made."""
    p = joins.by_match(t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity"), "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    j = joins.unordered_pairs(p, "l_orderkey", "l_suppkey", ["q"])
    # dealt before they are counted: few pairs of a part repeat, and each task's table of pairs keeps its size
    j = j.repartition(joins.parts(t.lineitem), "l_suppkey_a", "l_suppkey_b")
    return j.groupBy(F.col("l_suppkey_a").alias("a"), F.col("l_suppkey_b").alias("b")).agg(
        F.count("*").alias("meetings"), F.count_if(F.col("q_a") > F.col("q_b")).alias("wins_a"), F.count_if(F.col("q_a") < F.col("q_b")).alias("wins_b"),
        F.sum(F.col("q_a") - F.col("q_b")).alias("margin"),
    )


@query("""
WITH p AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity FROM lineitem)
SELECT pt.p_type AS type, count(DISTINCT a.l_orderkey) AS matches, round(avg(a.l_quantity), 4) AS q1, round(avg(b.l_quantity), 4) AS q2
FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = 1 AND b.l_suppkey = 2 JOIN part pt ON pt.p_partkey = a.l_partkey GROUP BY 1
""")
def h2h_two_supp(t: Tables):
    """Two participants in the same match, by arena type."""
    a = t.lineitem.filter("l_suppkey = 1").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("x"))
    b = t.lineitem.filter("l_suppkey = 2").select("l_orderkey", F.col("l_quantity").alias("y"))
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type"))
    return a.join(b, "l_orderkey").join(parts, "l_partkey").groupBy("type").agg(F.countDistinct("l_orderkey").alias("matches"), F.round(F.avg("x"), 4).alias("q1"), F.round(F.avg("y"), 4).alias("q2"))


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linestatus AS team, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT a.k AS orderkey, a.team AS team, a.q AS q, max(b.q) AS other, CASE WHEN max(b.q) IS NULL THEN NULL WHEN a.q > max(b.q) THEN 'win' WHEN a.q < max(b.q) THEN 'loss' ELSE 'draw' END AS outcome
FROM s a LEFT JOIN s b ON a.k = b.k AND a.team <> b.team GROUP BY 1, 2, 3
""")
def team_outcome(t: Tables):
    """A team's total against the best other team: the top two of each match in one window, no self join."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("orderkey"), F.col("l_linestatus").alias("team")).agg(F.sum("l_quantity").alias("q"))
    by = W.partitionBy("orderkey").orderBy(F.desc("q"), "team")
    every = W.partitionBy("orderkey")
    s = s.withColumn("r", F.row_number().over(by)).withColumn("first", F.max("q").over(every)).withColumn("second", F.max(F.when(F.col("r") == 2, F.col("q"))).over(every))
    s = s.withColumn("other", F.when(F.col("r") == 1, F.col("second")).otherwise(F.col("first")))
    outcome = F.when(F.col("q") > F.col("other"), "win").when(F.col("q") < F.col("other"), "loss").when(F.col("q") == F.col("other"), "draw")
    return s.select("orderkey", "team", "q", "other", outcome.alias("outcome"))


@query("""
WITH d AS (SELECT l_suppkey AS suppkey, c.c_nationkey AS nation, count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 2),
r AS (SELECT suppkey, CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 'AS-AF' ELSE r_name END AS region, sum(n) AS n FROM d JOIN nation ON n_nationkey = nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2)
SELECT suppkey, max(struct_pack(n := n, region := region)).region AS region, round(max(n) / sum(n), 6) AS confidence FROM r GROUP BY 1
""")
def region_argmax(t: Tables):
    """Dominant region after a remap, with its share."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    joined = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("suppkey")).join(o, "l_orderkey").join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("r_name").isin("ASIA", "AFRICA"), "AS-AF").otherwise(F.col("r_name")).alias("region"))
    per = joined.groupBy("suppkey", "c_nationkey").agg(F.count("*").alias("n")).join(geo, "c_nationkey").groupBy("suppkey", "region").agg(F.sum("n").alias("n"))
    return per.groupBy("suppkey").agg(F.max_by("region", F.struct("n", "region")).alias("region"), F.round(F.max("n") / F.sum("n"), 6).alias("confidence"))


@query("""
WITH f AS (SELECT o_orderpriority AS own, o_orderstatus AS enemy, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT o_orderpriority AS own, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT f.own, f.enemy, round(CASE WHEN f.n >= 4 THEN f.v ELSE g.v END, 4) AS bench, f.n >= 4 AS fine FROM f JOIN g USING (own)
""")
def benchmark_fallback(t: Tables):
    """The benchmark of priority and status; ``benchmark_fallback_all`` has finer keys, of which many fall back."""
    return _benchmark(t.orders.select(F.col("o_orderpriority").alias("own"), F.col("o_orderstatus").alias("enemy"), "o_totalprice"))


@query("""
WITH f AS (SELECT o_custkey AS own, o_orderpriority AS enemy, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT o_custkey AS own, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT f.own, f.enemy, round(CASE WHEN f.n >= 4 THEN f.v ELSE g.v END, 4) AS bench, f.n >= 4 AS fine FROM f JOIN g USING (own)
""")
def benchmark_fallback_all(t: Tables):
    """All orders, by customer and priority, so that both the finer and the coarse benchmark occur."""
    return _benchmark(t.orders.select(F.col("o_custkey").alias("own"), F.col("o_orderpriority").alias("enemy"), "o_totalprice"))


def _benchmark(o: DataFrame) -> DataFrame:
    """The finer benchmark if it has at least four rows, else the coarse one: both from one grouping-sets pass."""
    sets = o.groupingSets([[F.col("own"), F.col("enemy")], [F.col("own")]], "own", "enemy").agg(F.grouping("enemy").alias("g"), F.avg("o_totalprice").alias("v"), F.count("*").alias("n"))
    fine, coarse = sets.filter("g = 0"), sets.filter("g = 1").select("own", F.col("v").alias("c"))
    return fine.join(coarse, "own").select("own", "enemy", F.round(F.when(F.col("n") >= 4, F.col("v")).otherwise(F.col("c")), 4).alias("bench"), (F.col("n") >= 4).alias("fine"))


@query("""
WITH p AS (SELECT l_suppkey AS suppkey, count(*) AS n, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS rate, sum(l_quantity) / (sum(l_quantity) + 1000.0) AS p FROM lineitem GROUP BY 1)
SELECT suppkey, round(CASE WHEN n >= 10 THEN (n * rate + 8 * p) / (n + 8) ELSE p END, 6) AS blended, round(greatest(0.15, least(0.85, 0.5 + n / (n + 4.0) * (rate - 0.5))), 6) AS shrunk FROM p
""")
def h2h_blend(t: Tables):
    """Model probability blended with the record, and the small-sample shrink."""
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)).alias("rate"), (F.sum("l_quantity") / (F.sum("l_quantity") + 1000.0)).alias("p"))
    return p.select("suppkey", F.round(X.head_to_head_blend("p", "rate", "n"), 6).alias("blended"), F.round(X.small_sample("rate", "n"), 6).alias("shrunk"))


@query("""
WITH m AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS won FROM orders),
r AS (SELECT *, coalesce(sum(won) OVER w, 0) AS wins_a, coalesce(sum(1 - won) OVER w, 0) AS wins_b FROM m WINDOW w AS (PARTITION BY c ORDER BY d, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT c AS custkey, k AS orderkey, won, CAST(wins_a AS BIGINT) AS wins_a, CAST(wins_b AS BIGINT) AS wins_b FROM r WHERE wins_a < 2 AND wins_b < 2
""")
def first_to_two(t: Tables):
    """Games of a best of three up to the clinch."""
    m = t.orders.select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("won"))
    return windows.first_to(m, ["custkey"], ["d", "orderkey"], "won", 2).drop("d")


@query("""
WITH own AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_totalprice > 200000),
pool AS (SELECT c, o_orderkey AS k, o_totalprice AS v FROM (SELECT DISTINCT c FROM own), (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)),
b AS (SELECT *, 0 AS padded FROM own UNION ALL SELECT *, 1 FROM pool ANTI JOIN own USING (c, k))
SELECT c AS custkey, k AS orderkey, v AS price, padded, CAST(row_number() OVER (PARTITION BY c ORDER BY padded, v DESC, k) AS INTEGER) AS place FROM b QUALIFY place <= 5
""")
def topn_pad(t: Tables):
    """Five best of each participant, filled up from the best of all."""
    rows = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    own = rows.filter("price > 200000")
    best = rows.orderBy(F.desc("price"), "orderkey").limit(5).select("orderkey", "price")
    pool = own.select("custkey").distinct().join(F.broadcast(best)).select("custkey", "orderkey", "price")  # five rows
    return windows.padded_top(own, pool, "custkey", ["orderkey"], [F.desc("price"), F.col("orderkey")], 5)


@query("""
WITH a AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS sig, min(l_shipdate) AS at FROM lineitem GROUP BY 1)
SELECT array_to_string(sig, ',') AS sig, count(*) AS n, min(k) AS kept FROM a GROUP BY 1 HAVING count(*) > 1
""")
def sig_dedup(t: Tables):
    """Matches with the same participants: a signature, its size and the kept match."""
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    sig = F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sig")
    return a.groupBy(sig).agg(F.count("*").alias("n"), F.min("k").alias("kept")).filter("n > 1")


@query("""
SELECT c_custkey AS custkey, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderdate >= TIMESTAMP '2000-08-01') AS recent
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) >= 15 OR count(o_orderkey) FILTER (o_orderdate >= TIMESTAMP '2000-08-01') >= 4
""")
def cohort_or_threshold(t: Tables):
    """Enough matches ever, or enough of late."""
    recent = F.count_if(F.col("o_orderdate") >= F.lit("2000-08-01").cast("timestamp_ntz"))
    return t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"), recent.alias("recent")).filter("n >= 15 or recent >= 4")


@query("""
WITH p AS (SELECT l_suppkey AS s, l_returnflag AS f, avg(l_extendedprice) AS v, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2)
SELECT f AS flag, round(min(v), 4) AS lo, round(max(v), 4) AS hi, round(avg(v), 4) AS mid, round(min(d), 6) AS lo_d, round(max(d), 6) AS hi_d FROM p GROUP BY 1
""")
def two_level_minmax(t: Tables):
    """Axis ranges: extremes of means."""
    p = t.lineitem.groupBy("l_suppkey", F.col("l_returnflag").alias("flag")).agg(F.avg("l_extendedprice").alias("v"), F.avg("l_discount").alias("d"))
    return p.groupBy("flag").agg(F.round(F.min("v"), 4).alias("lo"), F.round(F.max("v"), 4).alias("hi"), F.round(F.avg("v"), 4).alias("mid"), F.round(F.min("d"), 6).alias("lo_d"), F.round(F.max("d"), 6).alias("hi_d"))
