"""Event-stream queries (event = telemetry tick, user = participant)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import aggs, joins, nearest, rating, windows
from arenaflow.plans.registry import Tables, query


def seconds():
    """Seconds since 1970 of the event, exact to the microsecond."""
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type FROM events)
SELECT a.event_id AS error_id, min(b.ts) AS first_ts, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR GROUP BY 1
""")
def event_interval_join(t: Tables):
    """Events within an interval after another: bucketed, so it is an equi join."""
    e = t.events.select("event_id", "user_id", "ts", "event_type", seconds().alias("s"))
    left = e.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("s").alias("start"), (F.col("s") + 6 * 3600).alias("stop"))
    right = e.filter("event_type <> 'error'").select("user_id", "ts", "s")
    return joins.interval_join(left, right, ["user_id"], "start", "stop", "s", 6 * 3600.0).groupBy("error_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


@query("""
SELECT event_id, next_ts, next_value FROM (SELECT e.event_id, first(n.ts ORDER BY n.ts) AS next_ts, first(n.value ORDER BY n.ts) AS next_value
FROM events e LEFT JOIN events n ON n.user_id = e.user_id AND n.event_type = 'purchase' AND n.ts > e.ts AND n.ts <= e.ts + INTERVAL 1 HOUR GROUP BY 1)
""")
def asof_next_event(t: Tables):
    """Next purchase of the user within an hour: one sort, no join."""
    e = joins.asof_next(t.events.select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], "ts", F.col("event_type") == "purchase", ["value"], "event_id")
    near = F.col("next_ts") <= F.col("ts") + F.expr("interval 1 hour")
    return e.select("event_id", F.when(near, F.col("next_ts")).alias("next_ts"), F.when(near, F.col("next_value")).alias("next_value"))


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, round(value - lag(value, 4) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta4 FROM events")
def lag_delta(t: Tables):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("value").over(w).alias("prev"), F.round(F.col("value") - F.lag("value", 4).over(w), 6).alias("delta4"))


@query("""
WITH b AS (SELECT user_id, floor(epoch(ts) / 300) AS tick, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2)
SELECT e.event_id AS event_id, b.n AS n, b.top AS top FROM events e JOIN b ON b.user_id = e.user_id AND b.tick = floor(epoch(e.ts) / 300)
""")
def tick_snap(t: Tables):
    """Events to ticks by an equal key."""
    e = t.events.select("event_id", "user_id", "value", F.floor(seconds() / 300).alias("tick"))
    b = e.groupBy("user_id", "tick").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return e.select("event_id", "user_id", "tick").join(b, ["user_id", "tick"]).select("event_id", "n", "top")


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, round(avg(v[i]), 6) AS m FROM v, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, arg_min(c.label, d) AS nearest FROM (SELECT v.vec_id, c.label AS label, round(list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) * 1000000 + c.label * 1e-4 AS d FROM v, c) c GROUP BY 1
""")
def nearest_vector(t: Tables):
    """Nearest label centroid: few centroids, sent to all vectors."""
    v = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    m = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("m"))
    c = m.groupBy(F.col("label").alias("nearest")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    d = F.round(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x), 9) * 1_000_000 + F.col("nearest") * 1e-4
    return joins.nearest_in_set(v.select("vec_id", "v"), c, ["vec_id"], d, "nearest").select("vec_id", "nearest")


@query("""
WITH c AS (SELECT min(p_partkey) AS part, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS DOUBLE) AS size FROM part GROUP BY 2, 3),
p AS (SELECT DISTINCT l_quantity AS q, l_extendedprice / l_quantity AS price, CAST(l_quantity AS DOUBLE) AS size FROM lineitem),
d AS (SELECT p.q AS q, p.price AS price, arg_min(c.part, (p.price - c.price) * (p.price - c.price) + (p.size - c.size) * (p.size - c.size), 1) AS part,
  min((p.price - c.price) * (p.price - c.price) + (p.size - c.size) * (p.size - c.size)) AS d2 FROM p, c GROUP BY 1, 2)
SELECT l.l_orderkey AS orderkey, l.l_linenumber AS line, round(sqrt(d.d2), 6) AS distance FROM lineitem l JOIN d ON d.q = l.l_quantity AND d.price = l.l_extendedprice / l.l_quantity
""")
def nearest_part(t: Tables):
    """The part whose price and size lie nearest to a line's unit price and quantity: neither side is small."""
    centres = t.part.select(F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_partkey").alias("part"))
    lines = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("line"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"))
    near = nearest.nearest(lines, centres, "line", ["price", "size"], "part")
    return near.select(F.col("line.l_orderkey").alias("orderkey"), F.col("line.l_linenumber").alias("line"), F.round("distance", 6).alias("distance"))


@query("SELECT strftime(ts, '%G-%V') AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def iso_week_trend(t: Tables):
    return t.events.groupBy(X.iso_week("ts").alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH g AS (SELECT d.i AS dow, h.i AS hour FROM range(7) d(i), range(24) h(i)), n AS (SELECT dayofweek(ts) AS dow, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
f AS (SELECT g.dow, g.hour, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (dow, hour))
SELECT CAST(dow AS INTEGER) AS dow, CAST(hour AS INTEGER) AS hour, n, CAST(least(5, floor(5.0 * n / max(n) OVER ())) AS BIGINT) AS level FROM f
""")
def dow_hour_grid(t: Tables):
    """Dense 7 x 24 grid with levels 0 to 5."""
    n = t.events.groupBy(X.day_of_week("ts").alias("dow"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    grid = n.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    full = grid.join(F.broadcast(n), ["dow", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # 168 rows
    return full.withColumn("level", F.least(F.lit(5), F.floor(5.0 * F.col("n") / F.max("n").over(W.partitionBy(F.lit(1))))))


@query("""
WITH n AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(w AS DATE) AS week, coalesce(n, 0) AS n FROM range(DATE '2000-01-03', DATE '2001-01-02', INTERVAL 7 DAY) r(w) LEFT JOIN n ON n.week = CAST(w AS DATE)
""")
def zero_fill_weeks(t: Tables):
    n = t.orders.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").alias("n"))
    return aggs.zero_filled(n, "week", "n", "2000-01-03", "2001-01-01", "7 days")


@query("""
WITH e AS (SELECT user_id, ts, value > 50 AS c, coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS p FROM events)
SELECT user_id, count(*) FILTER (c AND NOT p) AS edges FROM e GROUP BY 1
""")
def rising_edge(t: Tables):
    return windows.rising_edges(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", F.col("value") > 50, "event_id")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM i GROUP BY user_id, island
""")
def islands(t: Tables):
    """Runs of events with gaps of at most half an hour."""
    w = W.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes")
    rows = windows.islands(t.events.select("user_id", "ts"), ["user_id"], "ts", gap)
    return rows.groupBy("user_id", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n")).drop("island")


@query("SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase FROM events")
def time_to_next(t: Tables):
    c = windows.time_to_next(t.events, ["user_id"], F.col("ts"), "ts", F.col("event_type") == "purchase", "event_id")
    return t.events.select("event_id", c.alias("next_purchase"))


@query("SELECT event_id, max(value) OVER w AS top, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)")
def forward_frame(t: Tables):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 14)
    return t.events.select("event_id", F.max("value").over(w).alias("top"), F.count("*").over(w).alias("n"))


@query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, hour(ts) AS h, min(event_id) AS e FROM events GROUP BY 1, 2, 3)
SELECT a.user_id AS user_id, a.e AS a, b.e AS b FROM s a JOIN s b ON a.user_id = b.user_id AND a.d = b.d AND b.h = a.h + 1
""")
def near_dup_window(t: Tables):
    """Neighbouring time slots of one key: slots are a derived equi key."""
    s = t.events.groupBy("user_id", F.to_date("ts").alias("d"), F.hour("ts").alias("h")).agg(F.min("event_id").alias("e"))
    b = s.select("user_id", "d", (F.col("h") - 1).alias("h"), F.col("e").alias("b"))
    return s.withColumnRenamed("e", "a").join(b, ["user_id", "d", "h"]).select("user_id", "a", "b")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t: Tables):
    w = F.window("ts", "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""
WITH o AS (SELECT date_trunc('hour', ts) - INTERVAL (i) HOUR AS start, value FROM events, range(2) r(i)) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM o GROUP BY 1
""")
def sliding(t: Tables):
    """Two-hour windows every hour."""
    return t.events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, island
""")
def session(t: Tables):
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT conv_id, count(*) AS turns, max(CASE WHEN role = 'user' THEN turn END) AS last_user, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def last_turn(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS shape, count(*) AS n FROM conversations GROUP BY 1")
def ordered_roles(t: Tables):
    """The order of a bounded sequence as one string."""
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">").alias("shape"), F.count("*").alias("n"))


def sides(t: Tables):
    """Suppliers of orders, one row each: frags, damage and home; and the orders as matches, the customer's region as the server's."""
    lines = joins.by_match(t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"), "l_orderkey")
    p = lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("frags"), F.avg("l_extendedprice").alias("damage"))
    region = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    home = t.supplier.join(region, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region"))
    p = p.join(F.broadcast(home) if t.supplier.count() <= rating.MOST_SENT else home, "l_suppkey", "left")
    server = t.customer.join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("server_region"))
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("played_at"), F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("arena"), "o_custkey")
    return p, o.join(server, "o_custkey", "left")


def duels(t: Tables):
    """Duels of suppliers within orders as input of the rating: outcome, margin, damage, time, homes and the server's region."""
    p, orders = sides(t)
    pairs = joins.unordered_pairs(p, "l_orderkey", "l_suppkey", ["frags", "damage", "region"])
    return pairs.join(orders, "l_orderkey").select(
        "mode", "arena", F.col("l_orderkey").alias("match_id"), "played_at", F.col("l_suppkey_a").alias("a"), F.col("l_suppkey_b").alias("b"), "frags_a", "frags_b",
        F.col("damage_a").alias("given_a"), F.col("damage_b").alias("taken_a"), F.col("damage_b").alias("given_b"), F.col("damage_a").alias("taken_b"),
        "region_a", "region_b", "server_region")


def matches(t: Tables):
    """The same duels as a row an order, with its suppliers in an array (an order has few)."""
    p, orders = sides(t)
    own = p.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("player"), "frags", "damage", "region")).alias("sides"))
    return own.join(orders, "l_orderkey").select("mode", "arena", F.col("l_orderkey").alias("match_id"), "played_at", "server_region", "sides")


@query()
def rating_fold(t: Tables):
    """The order-dependent rating: components of players side by side, slices of time where duels are sparse; everything around it in parallel."""
    return rating.snapshots(duels(t), matches(t))


@query()
def rating_arenas(t: Tables):
    """Ratings by arena, with damage ratio, margins and opponents there."""
    return rating.ratings_of_arenas(duels(t), of_matches=matches(t))


@query()
def rating_arena_history(t: Tables):
    """What each arena's rating was before and after every duel."""
    return rating.history_of_arenas(duels(t), of_matches=matches(t))


@query("""
WITH p AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1)
SELECT 'orders with repeated participants' AS check_name, count(*) FILTER (n > d) AS violations FROM p UNION ALL
SELECT 'order ids repeat', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL
SELECT 'lines without order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL
SELECT 'null participants', count(*) FROM lineitem WHERE l_suppkey IS NULL
""")
def invariants(t: Tables):
    """A row for each check with its number of violations."""
    p = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("d"))
    name = lambda s: F.lit(s).alias("check_name")
    a = p.agg(F.count_if(F.col("n") > F.col("d")).alias("violations")).select(name("orders with repeated participants"), "violations")
    b = t.orders.agg((F.count("*") - F.countDistinct("o_orderkey")).alias("violations")).select(name("order ids repeat"), "violations")
    lost = t.lineitem.select("l_orderkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    c = lost.agg(F.count("*").alias("violations")).select(name("lines without order"), "violations")
    d = t.lineitem.agg(F.count_if(F.col("l_suppkey").isNull()).alias("violations")).select(name("null participants"), "violations")
    return a.union(b).union(c).union(d)
