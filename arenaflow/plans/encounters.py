"""Encounters over events (user = player, day = game), places of suppliers' addresses, deletions and windows as data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.functions.filters import Spec, where
from arenaflow.operators import combat, places, upserts
from arenaflow.plans.registry import Tables, query

#: Ten players hit each other: the event's user and number tell who whom.
HITS = """
h AS (SELECT event_id AS id, CAST(ts AS DATE) AS game, epoch_us(ts) // 1000 AS tm, user_id % 10 AS attacker, (user_id % 10 + 1 + event_id % 10) % 10 AS victim, value FROM events)
"""


def hits(t: Tables) -> DataFrame:
    who = F.col("user_id") % 10
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("game"), at.alias("at"), who.alias("attacker"), ((who + 1 + F.col("event_id") % 10) % 10).alias("victim"), "value")


@query(f"""
WITH {HITS}, r AS (SELECT a.id AS id, a.tm AS tm, arg_min(b.tm, (b.tm, b.id)) AS follow FROM h a LEFT JOIN h b
  ON b.game = a.game AND b.attacker = a.victim AND b.victim = a.attacker AND (b.tm, b.id) > (a.tm, a.id) WHERE a.attacker <> a.victim GROUP BY 1, 2)
SELECT id, CASE WHEN follow - tm <= 7200000 THEN follow - tm END AS reaction FROM r
""")
def return_fire(t: Tables):
    """How soon a hit player hits back."""
    return combat.return_fire(hits(t), ["game"], "at", "id", 7_200_000).select("id", "reaction")


@query(f"""
WITH {HITS}, s AS (SELECT id, game, attacker AS looker, victim AS seen, tm AS start, tm + CAST(floor(value * 10000) AS BIGINT) AS stop FROM h WHERE id % 3 = 0),
f AS (SELECT * FROM h WHERE id % 3 <> 0)
SELECT s.id AS id, min(f.tm - s.start) AS reaction FROM s LEFT JOIN f ON f.game = s.game AND f.attacker = s.looker AND f.victim = s.seen
  AND f.tm >= s.start AND f.tm <= s.stop + 60000 AND f.tm - s.start <= 3600000 GROUP BY 1
""")
def sight_reaction(t: Tables):
    """First hit on whom one sees, while the sight lasts or shortly after: each third event is a sight, the others are hits."""
    h = hits(t)
    sights = h.filter("id % 3 = 0").select(
        "id", "game", F.col("attacker").alias("looker"), F.col("victim").alias("seen"), F.col("at").alias("start"), (F.col("at") + F.floor(F.col("value") * 10000)).alias("stop"))
    return combat.sight_reactions(sights, h.filter("id % 3 <> 0"), ["game"], "at", 60_000, 3_600_000).select("id", "reaction")


def address(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


@query("""
WITH r AS (SELECT n_nationkey::BIGINT * 160000000 AS a, n_nationkey::BIGINT * 160000000 + 159999999 AS b, 'nation ' || n_name AS place FROM nation
  UNION ALL SELECT s_suppkey::BIGINT * 7000003 % 4000000000, s_suppkey::BIGINT * 7000003 % 4000000000 + 250000 + s_suppkey * 13 % 1000, 'supplier ' || s_name FROM supplier),
c AS (SELECT c_custkey, c_custkey::BIGINT * 2654435761 % 4294967296 AS n FROM customer WHERE c_custkey % 50 <> 0)
SELECT k.c_custkey AS custkey, arg_min(place, (b - a, a, place)) AS place FROM customer k LEFT JOIN c ON c.c_custkey = k.c_custkey LEFT JOIN r ON c.n BETWEEN r.a AND r.b GROUP BY 1
""")
def range_lookup(t: Tables):
    """The smallest address range that holds each customer's address; some addresses are malformed. Nations' ranges hold suppliers' and leave gaps."""
    n = F.col("n")
    wide = t.nation.select((F.col("n_nationkey").cast("long") * 160_000_000).alias("a"), (F.col("n_nationkey").cast("long") * 160_000_000 + 159_999_999).alias("b"), F.concat(F.lit("nation "), "n_name").alias("place"))
    at = (F.col("s_suppkey").cast("long") * 7_000_003 % 4_000_000_000).cast("long")
    small = t.supplier.select(at.alias("a"), (at + 250_000 + F.col("s_suppkey") * 13 % 1000).cast("long").alias("b"), F.concat(F.lit("supplier "), "s_name").alias("place"))
    ranges = wide.unionByName(small).select(address(F.col("a")).alias("first"), address(F.col("b")).alias("last"), "place")
    asked = t.customer.select(F.col("c_custkey").alias("custkey"), (F.col("c_custkey").cast("long") * 2_654_435_761 % 4_294_967_296).alias("n"))
    asked = asked.select("custkey", F.when(F.col("custkey") % 50 == 0, "none").otherwise(address(n)).alias("ip"))
    return places.located(asked, ranges).select("custkey", "place")


@query("""
WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT * FROM n)),
c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c))
SELECT 'customer' AS name, (SELECT count(*) FROM c) AS gone, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS kept UNION ALL
SELECT 'nation', (SELECT count(*) FROM n), (SELECT count(*) FROM nation) - (SELECT count(*) FROM n) UNION ALL
SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o) UNION ALL
SELECT 'region', 2, (SELECT count(*) FROM region) - 2 UNION ALL
SELECT 'supplier', (SELECT count(*) FROM s), (SELECT count(*) FROM supplier) - (SELECT count(*) FROM s)
""")
def cascade_delete(t: Tables):
    """What goes with two regions: nations, their customers and suppliers, and the orders."""
    tables = {n: getattr(t, n) for n in ("region", "nation", "supplier", "customer", "orders")}
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}
    foreign = [("nation", "n_regionkey", "region"), ("supplier", "s_nationkey", "nation"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer")]
    left, gone = upserts.cascade(tables, keys, foreign, {"region": t.region.filter(F.col("r_regionkey").isin(1, 3))})
    each = [gone[n].agg(F.count("*").alias("gone")).join(left[n].agg(F.count("*").alias("kept"))).select(F.lit(n).alias("name"), "gone", "kept") for n in sorted(tables)]  # one row a side
    out = each[0]
    for rows in each[1:]:
        out = out.union(rows)
    return out


@query("""
WITH w AS (SELECT * FROM (VALUES ('current', DATE '2000-07-03', DATE '2000-12-30'), ('prior', DATE '2000-01-05', DATE '2000-07-03'), ('year_ago', DATE '1999-07-04', DATE '1999-12-31')) v(shift, low, high))
SELECT shift, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN w ON o_orderdate >= low AND o_orderdate < high WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1
""")
def shifted_windows(t: Tables):
    """Half a year before a day, the half year before that one, and the same a year ago: filters as data, each pushed to its scan."""
    out = None
    for shift in ("current", "prior", "year_ago"):
        spec = Spec(equal={"o_orderpriority": ["1-URGENT", "2-HIGH"]}, at="o_orderdate", now=datetime(2000, 12, 30), days=180, shift=shift)
        one = where(t.orders, spec).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n > 0").select(F.lit(shift).alias("shift"), "n", "total")
        out = one if out is None else out.union(one)
    return out
