"""Identities under review: customers joined and kept apart by decisions, and what follows for their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.operators import aliases
from arenaflow.plans.registry import Tables, query

#: Decisions on customers: one nation, segment and balance (to 500) are one, then one nation and balance (to 50) are, but for each fifth customer, who is rejected.
DECISIONS = """
d AS (
  SELECT c_custkey AS number, c_custkey AS a, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 500)) AS b, true AS accept FROM customer
  UNION ALL SELECT 1000000000 + c_custkey, c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 50)), c_custkey % 5 <> 0 FROM customer
), f AS (SELECT least(a, b) AS a, greatest(a, b) AS b, arg_max(accept, number) AS accept FROM d WHERE a <> b GROUP BY 1, 2),
l AS (SELECT a, b FROM f WHERE accept UNION SELECT b, a FROM f WHERE accept),
r AS (SELECT a AS start, a AS node FROM l UNION SELECT r.start, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT start AS id, min(node) AS root FROM r GROUP BY 1),
o AS (SELECT o_orderkey, coalesce(c.root, o_custkey) AS custkey, o_orderdate FROM orders LEFT JOIN c ON c.id = o_custkey)
"""


def decisions(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    first = lambda *keys: F.min("c_custkey").over(W.partitionBy(*keys))
    one = c.select(F.col("c_custkey").alias("number"), F.col("c_custkey").alias("a"), first("c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500)).alias("b"), F.lit(True).alias("accept"))
    two = c.select(
        (F.col("c_custkey") + 1_000_000_000).alias("number"), F.col("c_custkey").alias("a"), first("c_nationkey", F.floor(F.col("c_acctbal") / 50)).alias("b"),
        (F.col("c_custkey") % 5 != 0).alias("accept"))
    return one.unionByName(two)


def orders(t: Tables, state: DataFrame) -> DataFrame:
    return aliases.repointed(t.orders.select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_orderdate"), state, "custkey")


@query(f"WITH RECURSIVE {DECISIONS} SELECT c.root AS root, count(*) AS members, max(n) AS orders FROM c LEFT JOIN (SELECT custkey, count(*) AS n FROM o GROUP BY 1) k ON k.custkey = c.root GROUP BY 1")
def alias_classes(t: Tables):
    """Classes of accepted pairs with their orders after these were re-pointed."""
    state = aliases.classes(decisions(t))
    n = orders(t, state).groupBy(F.col("custkey").alias("root")).agg(F.count("*").alias("orders"))
    return state.groupBy("root").agg(F.count("*").alias("members")).join(n, "root", "left")


@query(f"WITH RECURSIVE {DECISIONS} SELECT f.a AS a, f.b AS b, x.root AS root FROM f JOIN c x ON x.id = f.a JOIN c y ON y.id = f.b AND y.root = x.root WHERE NOT accept")
def alias_conflicts(t: Tables):
    """Rejected pairs that accepted ones connect."""
    d = decisions(t)
    return aliases.conflicts(aliases.classes(d), d)


@query(f"WITH RECURSIVE {DECISIONS} SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT custkey FROM o)")
def alias_orphans(t: Tables):
    """Customers without orders once these belong to their classes."""
    return aliases.orphans(t.customer.select(F.col("c_custkey").alias("custkey")), orders(t, aliases.classes(decisions(t))), "custkey")


@query(f"""
WITH RECURSIVE {DECISIONS}, m AS (SELECT custkey, count(*) AS matches, max(o_orderdate) AS last_seen FROM o GROUP BY 1 HAVING count(*) BETWEEN 5 AND 20),
v AS (SELECT coalesce(c.root, c_custkey) AS custkey, count(DISTINCT c_name) AS variants FROM customer LEFT JOIN c ON c.id = c_custkey GROUP BY 1)
SELECT c_custkey AS canonical_id, matches, variants, last_seen FROM customer JOIN m ON m.custkey = c_custkey JOIN v ON v.custkey = c_custkey
WHERE variants <= 1 AND c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'
""")
def alias_review(t: Tables):
    """Identities to look at: few orders, one spelling, neither hidden (a negative balance here) nor reviewed (a segment)."""
    state = aliases.classes(decisions(t))
    facts = orders(t, state).select(F.col("custkey").alias("canonical_id"), F.col("o_orderkey").alias("match_id"), "o_orderdate")
    names = aliases.repointed(t.customer.select(F.col("c_custkey").alias("canonical_id"), F.col("c_name").alias("raw_name")), state, "canonical_id")
    who = t.customer.select(F.col("c_custkey").alias("canonical_id"), (F.col("c_acctbal") < 0).alias("hidden"), (F.col("c_mktsegment") == "MACHINERY").alias("reviewed"))
    return aliases.review_queue(who, facts, names, "o_orderdate", 5, 20)
