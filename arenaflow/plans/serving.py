"""Profiles, server and region drill-downs, cards and health: order = match, supplier = participant, nation = server, region = region."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.functions import names as N
from arenaflow.operators import aggs, joins
from arenaflow.plans.registry import Tables, query


def matches(t: Tables):
    """Orders with the nation and region of their customer: both dimensions are fixed lists."""
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("regionkey"))
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    return t.orders.join(c, "o_custkey").join(n, "c_nationkey")


@query("""
SELECT l_suppkey AS suppkey, CASE WHEN grouping(o_orderstatus) = 0 THEN 'mode' WHEN grouping(o_orderpriority) = 0 THEN 'arena' WHEN grouping(y) = 0 THEN 'year' ELSE 'career' END AS slice,
 coalesce(o_orderstatus, o_orderpriority, y, '') AS member, count(*) AS n, round(avg(l_quantity) + 1e-9, 4) AS quantity, round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 4) AS price, count(*) FILTER (l_quantity > 25) AS wins
FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY GROUPING SETS ((l_suppkey), (l_suppkey, o_orderstatus), (l_suppkey, o_orderpriority), (l_suppkey, y))
""")
def player_profile(t: Tables):
    """Career and every slice of it from one scan: one list of metrics, several groupings."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("arena"), F.year("o_orderdate").cast("string").alias("year"))
    rows = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("suppkey"), "l_quantity", "l_extendedprice").join(o, "l_orderkey")
    slices = ["mode", "arena", "year"]
    own = F.col("suppkey")
    g = rows.groupingSets([[own], *[[own, F.col(s)] for s in slices]], own, *[F.col(s) for s in slices])
    kind = F.lit("career")
    for s in reversed(slices):
        kind = F.when(F.grouping(s) == 0, s).otherwise(kind)
    return g.agg(
        kind.alias("slice"), F.count("*").alias("n"), X.rounded(F.avg("l_quantity"), 4).alias("quantity"), X.rounded(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("price"),
        F.count_if(F.col("l_quantity") > 25).alias("wins")).select("suppkey", "slice", F.coalesce(*slices, F.lit("")).alias("member"), "n", "quantity", "price", "wins")


@query("""
WITH m AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name AS server, count(DISTINCT o_orderkey) AS matches, count(DISTINCT o_custkey) AS players, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS modes,
 arg_max(top, {'k': k, 't': top}) AS top_arena FROM m JOIN (SELECT c_nationkey AS ck, o_orderpriority AS top, count(*) AS k FROM m GROUP BY 1, 2) x ON x.ck = c_nationkey GROUP BY 1
""")
def server_list(t: Tables):
    """Servers with activity, modes and favourite arena; counts are summed by arena first, so nothing fans out."""
    m = matches(t).groupBy(F.col("n_name").alias("server"), "o_orderpriority").agg(
        F.count("*").alias("k"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.collect_set("o_orderstatus").alias("s"))
    players = matches(t).select(F.col("n_name").alias("server"), "o_custkey").distinct().groupBy("server").agg(F.count("*").alias("players"))
    modes = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), ",")
    s = m.groupBy("server").agg(
        F.sum("k").alias("matches"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"), modes.alias("modes"), F.max_by("o_orderpriority", F.struct("k", "o_orderpriority")).alias("top_arena"))
    return s.join(players, "server").select("server", "matches", "players", "first_seen", "last_seen", "modes", "top_arena")


@query("""
WITH n AS (SELECT n_name AS server, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
s AS (SELECT server, CAST(unnest(range(min(week), max(week) + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS week FROM n GROUP BY 1)
SELECT server, week, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (server, week)
""")
def server_weeks(t: Tables):
    """Weekly activity of every server from its first to its last week, missing weeks as 0."""
    n = matches(t).groupBy(F.col("n_name").alias("server"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").alias("n"))
    every = n.groupBy("server").agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))).alias("week"))
    return every.join(n, ["server", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""
WITH m AS (SELECT n_regionkey AS regionkey, o_custkey, o_orderkey, month(o_orderdate) AS mon, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT regionkey, arg_max(mon, {'k': k, 'm': -mon}) AS peak FROM (SELECT regionkey, mon, count(*) AS k FROM m GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT regionkey, arg_max(o_custkey, {'k': k, 'c': -o_custkey}) AS top_player FROM (SELECT regionkey, o_custkey, count(*) AS k FROM m GROUP BY 1, 2) GROUP BY 1)
SELECT regionkey, count(*) AS matches, count(DISTINCT o_custkey) AS players, count(*) FILTER (o_orderstatus = 'O') AS open, round(count(*) / sum(count(*)) OVER (), 6) AS share, any_value(peak) AS peak, any_value(top_player) AS top_player
FROM m JOIN p USING (regionkey) JOIN u USING (regionkey) GROUP BY 1
""")
def region_summary(t: Tables):
    """Totals, shares, peak month and busiest participant of the regions."""
    m = matches(t)
    by_player = m.groupBy("regionkey", "o_custkey").agg(F.count("*").alias("k"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    r = by_player.groupBy("regionkey").agg(F.sum("k").alias("matches"), F.count("*").alias("players"), F.sum("o").alias("open"), F.max_by("o_custkey", F.struct("k", -F.col("o_custkey"))).alias("top_player"))
    peak = m.groupBy("regionkey", F.month("o_orderdate").alias("mon")).agg(F.count("*").alias("k")).groupBy("regionkey").agg(F.max_by("mon", F.struct("k", -F.col("mon"))).alias("peak"))
    total = F.sum("matches").over(W.partitionBy(F.lit(1)))  # a row for each region
    return r.join(peak, "regionkey").select("regionkey", "matches", "players", "open", F.round(F.col("matches") / total, 6).alias("share"), "peak", "top_player")


@query("""
WITH s AS (SELECT o_custkey AS c, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1), j AS (SELECT c, n, round(v / n, 4) AS score, c_mktsegment AS seg FROM s JOIN customer ON c = c_custkey WHERE n >= 5),
a AS (SELECT 'all' AS section, *, row_number() OVER (ORDER BY score DESC, c) AS place FROM j QUALIFY place <= 20), b AS (SELECT seg AS section, *, row_number() OVER (PARTITION BY seg ORDER BY score DESC, c) AS place FROM j QUALIFY place <= 10)
SELECT section, c AS custkey, n, score, place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
""")
def sectioned_top(t: Tables):
    """The 20 best of all and the 10 best of each division."""
    s = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("score")).filter("n >= 5")
    j = s.join(t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("section")), "custkey")
    order = [F.desc("score"), F.col("custkey")]
    best = j.orderBy(*order).limit(20).withColumn("section", F.lit("all"))  # sorted by partial top-n, then 20 rows
    both = best.withColumn("most", F.lit(20)).unionByName(j.withColumn("most", F.lit(10)))
    return both.withColumn("place", F.row_number().over(W.partitionBy("section").orderBy(*order))).filter("place <= most").select("section", "custkey", "n", "score", "place")


@query("""
WITH h AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem),
l AS (SELECT l_suppkey AS s, n_regionkey AS r, median(l_quantity) AS ping FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) >= 10),
p AS (SELECT k, r_regionkey AS region, count(ping) AS covered, max(coalesce(ping, 40.0)) AS worst, round(avg(coalesce(ping, 40.0)), 6) AS mean FROM h CROSS JOIN region LEFT JOIN l ON l.s = h.s AND l.r = r_regionkey GROUP BY 1, 2)
SELECT k AS orderkey, region, covered, worst, mean FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY covered DESC, worst, mean, region) = 1
""")
def server_suggestion(t: Tables):
    """The region with the least worst latency for a match's members; members without a measured one get a fallback. Regions are five."""
    m = matches(t).select(F.col("o_orderkey").alias("l_orderkey"), "regionkey")
    ping = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("s"), "l_quantity").join(m, "l_orderkey").groupBy("s", "regionkey").agg(aggs.exact_median("l_quantity").alias("ping"), F.count("*").alias("n")).filter("n >= 10").drop("n")
    regions = t.region.agg(F.collect_list(F.col("r_regionkey").cast("int")).alias("all"))  # one row
    had = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").alias("s")).distinct()
    every = had.join(F.broadcast(regions)).select("orderkey", "s", F.explode("all").alias("regionkey")).join(ping, ["s", "regionkey"], "left")
    known = F.coalesce("ping", F.lit(40.0))
    p = every.groupBy("orderkey", F.col("regionkey").alias("region")).agg(F.count("ping").alias("covered"), F.max(known).alias("worst"), F.round(F.avg(known), 6).alias("mean"))
    first = F.min(F.struct((-F.col("covered")).alias("c"), "worst", "mean", "region", "covered"))
    return p.groupBy("orderkey").agg(first.alias("b")).select("orderkey", "b.region", "b.covered", "b.worst", "b.mean")


@query("""
WITH f AS (SELECT l_orderkey AS k, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_orderkey AS k, min(p_type) AS arena FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT arena, a.s AS suppkey, count(*) AS games, count(DISTINCT b.s) AS opponents, count(*) FILTER (a.q > b.q) AS wins, round(avg(a.q - b.q), 4) AS margin FROM f a JOIN f b ON a.k = b.k AND a.s <> b.s JOIN t ON t.k = a.k GROUP BY 1, 2
""")
def opponents_on_map(t: Tables):
    """Record of every participant on each arena over all opponents: pairs of a match's members, which are few."""
    lines = joins.by_match(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("suppkey"), "l_quantity"), "k")
    f = lines.groupBy("k", "suppkey").agg(F.sum("l_quantity").alias("q"))
    arena = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("p_type").alias("arena"))
    pairs = f.join(f.select("k", F.col("suppkey").alias("other"), F.col("q").alias("p")), "k").filter("suppkey <> other").join(arena, "k")
    # dealt before they are counted, so that each task's table of opponents keeps its size
    return pairs.repartition(joins.parts(t.lineitem), "arena", "suppkey").groupBy("arena", "suppkey").agg(F.count("*").alias("games"), F.countDistinct("other").alias("opponents"), F.count_if(F.col("q") > F.col("p")).alias("wins"), F.round(F.avg(F.col("q") - F.col("p")), 4).alias("margin"))


@query("""
WITH c AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT s AS suppkey, p AS partkey, n, round(n / sum(n) OVER (PARTITION BY s), 6) AS share, row_number() OVER (PARTITION BY s ORDER BY n DESC, p) AS place FROM c QUALIFY place <= 3
""")
def top_share(t: Tables):
    """The three most frequent picks of each participant and their share of all."""
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("suppkey").orderBy(F.desc("n"), "partkey"))
    return c.select("suppkey", "partkey", "n", F.round(aggs.share_of_total(["suppkey"], "n"), 6).alias("share"), place.alias("place")).filter("place <= 3")


@query("""
SELECT event_type AS source, count(*) AS n, max(ts) AS last, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) // 60000000 AS minutes, epoch(TIMESTAMP '2024-02-01' - max(ts)) > 43200 AS stale,
 count(*) FILTER (ts >= TIMESTAMP '2024-01-25') AS week, count(*) FILTER (ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-25') AS prior FROM events GROUP BY 1
""")
def freshness(t: Tables):
    """Age of the newest record of each source, whether it is stale, and the week beside the one before."""
    now = "2024-02-01"
    old = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))
    in_week = [F.count_if(X.relative_window("ts", now, 7, off)).alias(n) for n, off in (("week", 0), ("prior", 7))]
    return t.events.groupBy(F.col("event_type").alias("source")).agg(
        F.count("*").alias("n"), F.max("ts").alias("last"), F.floor(old / 60_000_000).alias("minutes"), (old > 43_200_000_000).alias("stale"), *in_week)


@query("""
WITH j AS (SELECT user_id, event_id, ts, value, first_value(value) OVER w AS f, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(value - f, 4) AS since_first, round(value - p, 4) AS since_last FROM j
""")
def journal(t: Tables):
    """Every entry against the participant's first and previous one."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return t.events.select("event_id", F.round(v - F.first("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 4).alias("since_first"), F.round(v - F.lag("value").over(w), 4).alias("since_last"))


@query("""
WITH m AS (SELECT p_type AS arena, l_suppkey AS s, count(*) AS n, round(avg(l_quantity), 6) AS mu FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT arena, s AS suppkey, n, mu, CASE WHEN n >= 5 THEN rank() OVER (PARTITION BY arena, n >= 5 ORDER BY mu DESC) END AS place, count(*) FILTER (n >= 5) OVER (PARTITION BY arena) AS of_all FROM m
""")
def map_rankings(t: Tables):
    """Ranks on each arena; participants with few games stand in the list without a rank."""
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("arena"))
    m = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("suppkey"), "l_quantity").join(p, "l_partkey").groupBy("arena", "suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mu"))
    ok = F.col("n") >= 5
    rank = F.rank().over(W.partitionBy("arena", ok).orderBy(F.desc("mu")))
    return m.select("arena", "suppkey", "n", "mu", F.when(ok, rank).alias("place"), F.count_if(ok).over(W.partitionBy("arena")).alias("of_all"))


@query("""
WITH a AS (SELECT url, page_id, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host FROM pages), n AS (SELECT host, count(*) AS n FROM a GROUP BY 1)
SELECT host, n, row_number() OVER (PARTITION BY split_part(reverse(host), '.', 1) ORDER BY n DESC, length(host), host) AS place FROM n QUALIFY place <= 25
""")
def search_order(t: Tables):
    """Candidates of each last label by use, then length: the order of a search box, 25 each."""
    n = t.pages.select(N.host("url").alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    last = F.element_at(F.split("host", r"\."), -1)
    return n.withColumn("place", F.row_number().over(W.partitionBy(last).orderBy(F.desc("n"), F.length("host"), "host"))).filter("place <= 25")


@query("""
WITH r AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS played_at, o_totalprice AS v, lag(o_totalprice) OVER w AS p, row_number() OVER w AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT c AS custkey, k AS orderkey, played_at, v AS value, round(coalesce(v - p, 0), 2) AS change, i AS game FROM r
""")
def rating_history(t: Tables):
    """The series of a participant's values with the step from game to game."""
    w = W.partitionBy("custkey").orderBy("played_at", "orderkey")
    r = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("played_at"), F.col("o_totalprice").alias("value"))
    return r.withColumns({"change": F.round(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)), 2), "game": F.row_number().over(w)})
