"""Upserts of every kind, records of a ladder, dials of tracks, win splits and regions with exclusions, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import frames, identity, ladder, upserts
from arenaflow.plans.registry import Tables, query

#: The stored table lacks each third order, the batch holds each second one with other values, some of them null.
UPSERT_SQL = """
old AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice * 2, 2) END AS v, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 2 = 0)
"""


def stored(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))


def batch(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    v, s = F.when(key % 5 != 0, F.round(F.col("o_totalprice") * 2, 2)), F.when(key % 7 != 0, F.col("o_orderstatus"))
    return t.orders.filter("o_orderkey % 2 = 0").select(key.alias("k"), v.alias("v"), s.alias("s"))


@query(f"WITH {UPSERT_SQL} SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new")
def upsert_replace(t: Tables):
    """New rows take the place of stored ones."""
    return upserts.replace(stored(t), batch(t), ["k"])


@query(f"WITH {UPSERT_SQL} SELECT coalesce(new.k, old.k) AS k, coalesce(new.v, old.v) AS v, coalesce(new.s, old.s) AS s FROM old FULL JOIN new ON new.k = old.k")
def upsert_coalesce(t: Tables):
    """New values take the place of stored ones, nulls keep them."""
    return upserts.coalesce_update(stored(t), batch(t), ["k"])


@query(f"WITH {UPSERT_SQL} SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def insert_ignore(t: Tables):
    """Only rows with new keys come in."""
    return upserts.insert_ignore(stored(t), batch(t), ["k"])


@query(f"WITH {UPSERT_SQL} SELECT new.* FROM new JOIN old ON old.k = new.k WHERE new.v IS DISTINCT FROM old.v OR new.s IS DISTINCT FROM old.s")
def changed_rows(t: Tables):
    """Stored rows that a batch would change: what has to be written."""
    return upserts.changed(stored(t), batch(t), ["k"], ["v", "s"])


@query("SELECT l_orderkey AS orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS partkey, max(l_shipdate) AS shipdate FROM lineitem GROUP BY 1")
def last_of_batch(t: Tables):
    """One row for each key of a batch, the last one."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), F.col("l_shipdate").alias("shipdate"), "l_linenumber")
    return upserts.last_wins(rows, ["orderkey"], [F.desc("shipdate"), F.desc("l_linenumber"), F.desc("partkey")]).drop("l_linenumber")


@query("""
WITH m AS (SELECT o_orderkey AS k, o_custkey % 40 AS a, (o_custkey % 40 + 1 + o_orderkey % 39) % 40 AS b, o_orderdate AS at_, o_totalprice > 150000 AS won FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT a AS team_id, at_, won FROM m UNION ALL SELECT b, at_, NOT won FROM m)
SELECT CAST(team_id AS BIGINT) AS team_id, count(*) AS played, count(*) FILTER (won) AS wins, max(at_) FILTER (won) AS last_win, max(at_) FILTER (NOT won) AS last_loss FROM s GROUP BY 1
""")
def ladder_records(t: Tables):
    """Played and won matches of teams, with the last win and loss; open matches don't count."""
    a = (F.col("o_custkey") % 40).cast("long")
    b = ((a + 1 + F.col("o_orderkey") % 39) % 40).cast("long")
    won = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_totalprice") > 150000, a).otherwise(b))
    return ladder.records(t.orders.select(a.alias("team_a_id"), b.alias("team_b_id"), won.alias("winner_id"), F.col("o_orderdate").alias("played_at")))


@query("""
WITH s AS (SELECT user_id, event_id * 0.05::DOUBLE AS t, value * 50 AS x, CAST(event_id % 7 * 20 AS DOUBLE) AS y, CAST(event_id % 11 * 5 AS DOUBLE) AS z, CAST(event_id * 37 % 360 AS DOUBLE) AS yaw FROM events),
a AS (SELECT user_id, count(*) AS frames, max(t) - min(t) AS seconds FROM s GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, yaw - lag(yaw) OVER w AS da FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
v AS (SELECT user_id, t, dt, dx / dt AS vx, dy / dt AS vy, dz / dt AS vz, sqrt(dx / dt * (dx / dt) + dy / dt * (dy / dt)) AS speed, ((((da + 180) % 360) + 360) % 360 - 180) / dt AS turn FROM d WHERE dt > 0),
f AS (SELECT *, speed <= 5000 AND abs(vz) <= 5000 AS fine, CASE WHEN speed <= 5000 AND abs(vz) <= 5000 AND speed >= 50 THEN degrees(atan2(vy, vx)) END AS heading FROM v),
g AS (SELECT *, (((heading - lag(heading) OVER (PARTITION BY user_id ORDER BY t) + 180) % 360 + 360) % 360 - 180) / dt AS swing FROM f),
h AS (SELECT *, vz > 200 AND NOT coalesce(lag(vz > 200) OVER w, false) AS jump, sum(CAST(speed >= 30 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS stops FROM g WHERE fine WINDOW w AS (PARTITION BY user_id ORDER BY t)),
p AS (SELECT user_id, count(*) AS pauses, sum(s) AS paused FROM (SELECT user_id, stops, sum(dt) AS s FROM h WHERE speed < 30 GROUP BY 1, 2 HAVING sum(dt) >= 0.3) GROUP BY 1)
SELECT a.user_id AS user_id, any_value(frames) AS frames, round(any_value(seconds), 6) AS seconds, round(round(avg(speed), 2) + 1e-9, 1) AS speed_mean, round(round(quantile_cont(speed, 0.95), 2) + 1e-9, 1) AS speed_p95, count(*) FILTER (jump) AS jumps,
  coalesce(any_value(pauses), 0) AS pauses, count(swing) AS coupled FROM a JOIN h ON h.user_id = a.user_id LEFT JOIN p ON p.user_id = a.user_id GROUP BY 1
""")
def track_dials(t: Tables):
    """Dials of tracks: a user's events stand for samples."""
    e, double = F.col("event_id"), "double"
    s = t.events.select(
        "user_id", (e * 0.05).alias("t"), (F.col("value") * 50).alias("x"), (e % 7 * 20).cast(double).alias("y"), (e % 11 * 5).cast(double).alias("z"), (e * 37 % 360).cast(double).alias("yaw"))
    d = frames.track_dials(s, ["user_id"], "t").filter("speed_mean is not null")
    return d.select("user_id", "frames", F.round("seconds", 6).alias("seconds"), X.rounded("speed_mean", 1).alias("speed_mean"), X.rounded("speed_p95", 1).alias("speed_p95"), "jumps", "pauses", "coupled")


@query("""
WITH g AS (SELECT l_suppkey AS s, l_returnflag AS r, l_quantity AS q, l_linenumber AS mine, l_linenumber + CAST(l_quantity AS INTEGER) % 7 AS total FROM lineitem)
SELECT s AS suppkey, count(*) AS games, count(*) FILTER (r = 'A') AS wins, count(*) FILTER (r = 'R') AS losses,
  round(avg(q) FILTER (r = 'A') + 1e-9, 1) AS quantity_win, round(avg(q) FILTER (r = 'R') + 1e-9, 1) AS quantity_loss, round(avg(q) + 1e-9, 1) AS quantity_all,
  round(sum(mine) FILTER (r = 'A') / sum(total) FILTER (r = 'A') + 1e-9, 3) AS share_win, round(sum(mine) FILTER (r = 'R') / sum(total) FILTER (r = 'R') + 1e-9, 3) AS share_loss, round(sum(mine) / sum(total) + 1e-9, 3) AS share_all FROM g GROUP BY 1
""")
def win_split(t: Tables):
    """Means over won, lost and all games, and rates pooled over their counts."""
    result = F.when(F.col("l_returnflag") == "A", "W").when(F.col("l_returnflag") == "R", "L").otherwise("D")
    g = t.lineitem.select(
        F.col("l_suppkey").alias("suppkey"), result.alias("result"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("mine"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 7).alias("total"))
    return frames.win_split(g, ["suppkey"], ["quantity"], {"share": ("mine", "total")})


@query("""
WITH k AS (SELECT c_nationkey AS g, 'Cust#' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END AS key FROM customer),
w AS (SELECT DISTINCT c_nationkey AS g, CASE c_custkey % 4 WHEN 0 THEN 'Cust#' || c_custkey WHEN 1 THEN upper('Cust#' || c_custkey) WHEN 2 THEN 'cust ' || c_custkey || '.' ELSE substr('Cust#' || c_custkey, 1, 6) END AS name FROM customer),
f AS (SELECT *, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS kf FROM k), v AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS wf FROM w),
h AS (SELECT v.g, name, key, CASE WHEN key = name THEN 0 WHEN lower(key) = lower(name) THEN 1 WHEN kf = wf THEN 2 WHEN length(kf) >= 4 AND length(wf) >= 4 AND (starts_with(kf, wf) OR starts_with(wf, kf)) THEN 3 END AS kind FROM v JOIN f ON f.g = v.g)
SELECT CAST(v.g AS BIGINT) AS nation, v.name AS name, any_value(b.key) AS key, CAST(any_value(b.kind) AS INTEGER) AS kind FROM v LEFT JOIN (SELECT g, name, arg_min(key, (kind, key)) AS key, min(kind) AS kind FROM h WHERE kind IS NOT NULL GROUP BY 1, 2) b ON b.g = v.g AND b.name = v.name GROUP BY 1, 2
""")
def name_keys(t: Tables):
    """Names among a group's keys: exact, but for case, but for signs, or one's beginning."""
    c, own = t.customer, F.concat(F.lit("Cust#"), F.col("c_custkey").cast("string"))
    known = c.select(F.col("c_nationkey").cast("long").alias("group"), F.concat(own, F.when(F.col("c_custkey") % 3 == 0, "!").otherwise("")).alias("key"))
    part = F.col("c_custkey") % 4
    name = F.when(part == 0, own).when(part == 1, F.upper(own)).when(part == 2, F.concat(F.lit("cust "), F.col("c_custkey").cast("string"), F.lit("."))).otherwise(F.substring(own, 1, 6))
    wanted = c.select(F.col("c_nationkey").cast("long").alias("group"), name.alias("name")).distinct()
    return identity.resolve_key(wanted, known).withColumnRenamed("group", "nation")


@query("""
WITH r AS (SELECT l_suppkey AS s, CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 'AS-AF' ELSE r_name END AS region, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE NOT (o_orderpriority LIKE '1-%' AND o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') GROUP BY 1, 2)
SELECT s AS suppkey, arg_max(region, (n, region)) AS region, round(max(n) / sum(n) + 1e-9, 3) AS confidence, string_agg(region || ':' || n, ',' ORDER BY region) AS distribution FROM r GROUP BY 1
""")
def region_assignment(t: Tables):
    """Home regions with their distribution; orders of one tag within a year are left out, up to the first moment of its last day."""
    o = t.orders.filter(~(F.col("o_orderpriority").startswith("1-") & F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))))
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("r_name").isin("ASIA", "AFRICA"), "AS-AF").otherwise(F.col("r_name")).alias("region"))
    home = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("suppkey")).join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(home, "o_custkey")
    n = rows.groupBy("suppkey", "c_nationkey").agg(F.count("*").alias("n")).join(geo, "c_nationkey").groupBy("suppkey", "region").agg(F.sum("n").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "region", F.col("n").cast("string"))))  # a row for each region
    return n.groupBy("suppkey").agg(F.max_by("region", F.struct("n", "region")).alias("region"), X.rounded(F.max("n") / F.sum("n"), 3).alias("confidence"), F.array_join(parts, ",").alias("distribution"))
