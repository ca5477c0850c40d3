"""Projections, filters, joins, sets and plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.functions import names as N
from arenaflow.operators import aggs, joins, ranks
from arenaflow.plans.registry import Tables, query


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'win' WHEN l_quantity < 25 THEN 'loss' ELSE 'draw' END AS outcome, round(l_discount / nullif(l_tax, 0), 6) AS ratio FROM lineitem")
def proj_filter_case(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(q > 25, "win").when(q < 25, "loss").otherwise("draw").alias("outcome"), F.round(F.try_divide("l_discount", "l_tax"), 6).alias("ratio"))


@query("""SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, json_extract(props, '$.missing') IS NOT NULL AS has FROM events""")
def nested_default_json(t: Tables):
    """A path of a JSON text with a default, and whether a path exists."""
    j = F.from_json("props", "k long")
    return t.events.select("event_id", F.coalesce(j["k"], F.lit(0)).alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("has"))


@query("""
SELECT o_custkey AS custkey, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderdate < TIMESTAMP '2001-07-01') AS now,
 count(*) FILTER (o_orderdate >= TIMESTAMP '2000-07-05' AND o_orderdate < TIMESTAMP '2001-01-01') AS prior FROM orders GROUP BY 1
""")
def window_range_prior(t: Tables):
    """A window and the one before, half-open, from one scan."""
    now = X.half_open("o_orderdate", "2001-01-01", "2001-07-01")
    prior = X.half_open("o_orderdate", "2000-07-05", "2001-01-01")
    return t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count_if(now).alias("now"), F.count_if(prior).alias("prior"))


@query("SELECT p_partkey AS partkey, p_name AS name, count(l_partkey) AS uses FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_name ILIKE '%1%' GROUP BY 1, 2")
def like_search(t: Tables):
    p = t.part.filter(F.col("p_name").ilike("%1%")).select("p_partkey", "p_name")
    n = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return p.join(n, p.p_partkey == n.l_partkey, "left").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.coalesce("n", F.lit(0)).alias("uses"))


@query(r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, CASE WHEN regexp_matches(host, '(^|\.)(de|fr|es|uk|eu)\b') THEN 'EU' WHEN regexp_matches(host, '\.com$') THEN 'NA' WHEN regexp_matches(host, '\.net$') THEN 'SA' WHEN regexp_matches(host, '\.org$') THEN 'OC' END AS region FROM h
""")
def regex_first_match(t: Tables):
    """Ordered host rules, the first match counts."""
    return t.pages.select("page_id", N.host("url").alias("host")).withColumn("region", N.first_rule("host"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31')")
def lan_exclusion(t: Tables):
    """Rows outside tagged date ranges; the upper bound is that day's midnight."""
    d = F.col("o_orderdate").between(F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-12-31").cast("timestamp_ntz"))
    return t.orders.filter(~(F.col("o_orderpriority").like("1%") & d)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE nullif(l_discount, 0) IS DISTINCT FROM nullif(l_tax, 0)")
def null_safe_diff(t: Tables):
    z = F.lit(0.0)
    return t.lineitem.filter(~F.nullif("l_discount", z).eqNullSafe(F.nullif("l_tax", z))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS display, n_name AS nation FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 LEFT JOIN nation ON n_nationkey = s_nationkey")
def join_left_dim_coalesce(t: Tables):
    """A dimension with a display fallback; its predicate stands in the join, so no line is lost."""
    s = t.supplier.filter("s_acctbal > 0").join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "s_name", "n_name")
    return t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("s_name", F.col("l_suppkey").cast("string")).alias("display"), F.col("n_name").alias("nation"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_orderkey AS orderkey, a.l_partkey AS partkey, min(b.l_partkey) AS opponent FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2
""")
def opponent_lateral(t: Tables):
    """The smallest other one of the match: the two smallest of a match tell it, without a self join."""
    d = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey")).distinct()
    w = W.partitionBy("orderkey")
    d = d.withColumn("low", F.min("partkey").over(w))
    second = F.min(F.when(F.col("partkey") > F.col("low"), F.col("partkey"))).over(w)
    return d.select("orderkey", "partkey", F.when(F.col("partkey") > F.col("low"), F.col("low")).otherwise(second).alias("opponent"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_in(t: Tables):
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(t: Tables):
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(r"""
WITH h AS (SELECT page_id, split_part(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), ':', 1) AS host FROM pages), n AS (SELECT host, count(*) AS n FROM h GROUP BY 1)
SELECT page_id, host, n FROM h JOIN n USING (host)
""")
def derived_key_join(t: Tables):
    h = t.pages.select("page_id", N.host_root(N.host("url")).alias("host"))
    return h.join(h.groupBy("host").agg(F.count("*").alias("n")), "host").select("page_id", "host", "n")


@query(r"SELECT DISTINCT ON (host) host, page_id, url FROM (SELECT lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host, page_id, url FROM pages) ORDER BY host, page_id")
def distinct_on_host(t: Tables):
    """First page of each host: a partial aggregate, so that no host's pages meet in one place."""
    return t.pages.select(N.host("url").alias("host"), "page_id", "url").groupBy("host").agg(F.min(F.struct("page_id", "url")).alias("m")).select("host", "m.*")


@query("""
WITH m AS (SELECT l_orderkey AS m, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1 HAVING min(l_suppkey) < max(l_suppkey))
SELECT s_suppkey AS suppkey, count(*) AS matches, count(*) FILTER (a = s_suppkey) AS as_a FROM supplier JOIN m ON a = s_suppkey OR b = s_suppkey GROUP BY 1
""")
def or_side_join(t: Tables):
    """Either side of a match: sides become rows, so the join stays an equi join."""
    m = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")).filter("a < b")
    sides = m.select(F.explode(F.array(F.struct(F.col("a").alias("suppkey"), F.lit(1).alias("first")), F.struct(F.col("b").alias("suppkey"), F.lit(0).alias("first")))).alias("s")).select("s.*")
    n = sides.groupBy("suppkey").agg(F.count("*").alias("matches"), F.count_if(F.col("first") == 1).alias("as_a"))
    return n.join(t.supplier.select(F.col("s_suppkey").alias("suppkey")), "suppkey", "left_semi")


@query(r"""
WITH p AS (SELECT page_id, list_extract(string_split(url, '/'), -1) AS base FROM pages)
SELECT page_id, base, first, n FROM p JOIN (SELECT base, min(page_id) AS first, count(*) AS n FROM p GROUP BY 1) USING (base)
""")
def basename_join(t: Tables):
    """Every page beside the first of those whose url ends in the same file name."""
    p = t.pages.select("page_id", N.basename("url").alias("base"))
    return p.join(p.groupBy("base").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "base").select("page_id", "base", "first", "n")


@query("""
WITH p AS (SELECT l_suppkey AS s, c_nationkey % 5 AS r, avg(l_extendedprice) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT s_suppkey AS suppkey, r_regionkey AS regionkey, round(coalesce(v, 1000.0 + 10 * abs(s_nationkey - r_regionkey)), 4) AS price, v IS NULL AS estimated
FROM supplier CROSS JOIN region LEFT JOIN p ON s = s_suppkey AND r = r_regionkey
""")
def cross_fallback(t: Tables):
    """Every participant with every region: the real price where there is one, else an estimate."""
    return _cross_fallback(t, t.orders)


@query("""
WITH p AS (SELECT l_suppkey AS s, c_nationkey % 5 AS r, avg(l_extendedprice) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT s_suppkey AS suppkey, r_regionkey AS regionkey, round(coalesce(v, 1000.0 + 10 * abs(s_nationkey - r_regionkey)), 4) AS price, v IS NULL AS estimated
FROM supplier CROSS JOIN region LEFT JOIN p ON s = s_suppkey AND r = r_regionkey
""")
def cross_fallback_all(t: Tables):
    return _cross_fallback(t, t.orders)


def _cross_fallback(t: Tables, orders: DataFrame) -> DataFrame:
    """Every participant with every place, real values where there are any, else an estimate. The five regions are sent to all."""
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    real = t.lineitem.join(o, "l_orderkey").join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").groupBy(F.col("l_suppkey").alias("s_suppkey"), (F.col("c_nationkey") % 5).alias("r_regionkey")).agg(F.avg("l_extendedprice").alias("v"))
    grid = t.supplier.select("s_suppkey", "s_nationkey").crossJoin(F.broadcast(t.region.select("r_regionkey")))
    out = grid.join(real, ["s_suppkey", "r_regionkey"], "left")
    guess = 1000.0 + 10 * F.abs(F.col("s_nationkey") - F.col("r_regionkey"))
    return out.select(F.col("s_suppkey").alias("suppkey"), F.col("r_regionkey").alias("regionkey"), F.round(F.coalesce("v", guess), 4).alias("price"), F.col("v").isNull().alias("estimated"))


@query("SELECT l_returnflag AS flag, round(avg(l_discount / nullif(l_tax, 0)), 6) AS mean_of_ratio, round(sum(l_discount) / nullif(sum(l_tax), 0), 6) AS ratio_of_sum FROM lineitem GROUP BY 1")
def mean_of_ratio_vs_ratio_of_sum(t: Tables):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.avg(F.try_divide("l_discount", "l_tax")), 6).alias("mean_of_ratio"), F.round(F.try_divide(F.sum("l_discount"), F.sum("l_tax")), 6).alias("ratio_of_sum"))


@query("""
WITH p AS (SELECT l_orderkey AS k, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT s AS suppkey, round(sum(q) / sum(total), 6) AS share FROM (SELECT s, q, sum(q) OVER (PARTITION BY k) AS total FROM p) GROUP BY 1
""")
def share_control(t: Tables):
    """Own part of what all in its matches took."""
    p = t.lineitem.groupBy("l_orderkey", F.col("l_suppkey").alias("suppkey")).agg(F.sum("l_quantity").alias("q")).withColumn("total", F.sum("q").over(W.partitionBy("l_orderkey")))
    return p.groupBy("suppkey").agg(F.round(F.try_divide(F.sum("q"), F.sum("total")), 6).alias("share"))


@query("""
SELECT o_custkey AS custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS kinds, bool_or(o_totalprice > 300000) AS big
FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') AND count(*) FILTER (o_orderstatus = 'O') >= 2
""")
def cond_counts(t: Tables):
    s = F.col("o_orderstatus")
    return t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.countDistinct(F.when(s == "F", F.col("o_orderpriority"))).alias("kinds"),
        F.bool_or(F.col("o_totalprice") > 300000).alias("big")).filter("f > 0 and o >= 2")


@query("SELECT o_custkey AS custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def string_agg_sorted(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("""SELECT c_nationkey AS nationkey, '[' || string_agg('{"s":"' || c_mktsegment || '","n":' || n || '}', ',' ORDER BY c_mktsegment) || ']' AS rows FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def json_agg(t: Tables):
    """A JSON array of a bounded number of objects for each key."""
    n = t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n"))
    return n.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("rows"))


@query("SELECT c_nationkey AS nationkey, round(quantile_cont(c_acctbal, 0.5), 4) AS exact, list_sort(list(c_acctbal))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper, quantile_disc(c_acctbal, 0.5) AS disc FROM customer GROUP BY 1")
def median_three_ways(t: Tables):
    """The three medians in use, kept apart."""
    m = ranks.medians(t.customer.select(F.col("c_nationkey").alias("nationkey"), "c_acctbal"), ["nationkey"], "c_acctbal")
    return m.select("nationkey", F.round("middle", 4).alias("exact"), "upper", F.col("lower").alias("disc"))


@query("""
SELECT user_id, round(CASE WHEN count(*) >= 30 THEN corr(value, CAST(json_extract_string(props, '$.k') AS DOUBLE)) END, 6) AS r, count(*) AS n FROM events GROUP BY 1
""")
def corr_floor(t: Tables):
    e = t.events.select("user_id", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return e.groupBy("user_id").agg(F.round(aggs.corr_with_floor("value", "k", 30), 6).alias("r"), F.count("*").alias("n"))


@query("SELECT event_type, CASE WHEN value < 10 THEN '0-10' WHEN value < 50 THEN '10-50' WHEN value < 100 THEN '50-100' ELSE '100+' END AS band, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def band_sum(t: Tables):
    v = F.col("value")
    band = F.when(v < 10, "0-10").when(v < 50, "10-50").when(v < 100, "50-100").otherwise("100+")
    return t.events.groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS nationkey, c_acctbal FROM customer ORDER BY nationkey DESC NULLS LAST, c_acctbal, c_custkey LIMIT 50")
def sorted_nulls_last(t: Tables):
    c = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nationkey"), "c_acctbal")
    return c.orderBy(F.col("nationkey").desc_nulls_last(), "c_acctbal", "c_custkey").limit(50)


@query("SELECT DISTINCT k AS id FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_algebra(t: Tables):
    a = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    b = t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    p = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return a.union(b).distinct().join(p, "id", "left_anti")


@query("""
WITH h AS (SELECT user_id, list_sort(list(DISTINCT hour(ts))) AS hours FROM events GROUP BY 1)
SELECT a.user_id AS a, b.user_id AS b, list_min(list_intersect(a.hours, b.hours)) AS slot, CAST(len(list_intersect(a.hours, b.hours)) AS INTEGER) AS common FROM h a JOIN h b ON b.user_id = a.user_id + 1
""")
def slot_intersection(t: Tables):
    """Earliest hour that two members share."""
    h = t.events.groupBy("user_id").agg(F.collect_set(F.hour("ts").cast("long")).alias("hours"))
    b = h.select((F.col("user_id") - 1).alias("user_id"), F.col("user_id").alias("b"), F.col("hours").alias("other"))
    both = F.array_intersect("hours", "other")
    return h.join(b, "user_id").select(F.col("user_id").alias("a"), "b", F.array_min(both).alias("slot"), F.size(both).alias("common"))


@query("SELECT o_orderkey, -CAST('0x' || substr(sha256(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || '|' || o_custkey), 1, 15) AS BIGINT) AS id FROM orders")
def hash_id(t: Tables):
    key = F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", X.hash_id(key).alias("id"))


@query("SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def norm_text(t: Tables):
    return t.part.groupBy(N.squeezed("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("""
WITH p AS (SELECT s_suppkey AS k, s_nationkey * 3.0 - 36 AS lat, (s_suppkey % 36) * 10.0 - 180 AS lon, s_acctbal AS v FROM supplier)
SELECT k AS suppkey, round(2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians(50) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(50)) * power(sin(radians(8 - lon) / 2), 2)))), 4) AS km,
 round((((lon - 170 + 180) % 360) + 360) % 360 - 180, 4) AS arc, round(degrees(atan2(lat, lon)), 6) AS heading, round(1 / (1 + exp(-v / 1000)), 6) AS logistic, round(70 * tanh(v / 2575), 6) AS margin FROM p
""")
def angles_and_distances(t: Tables):
    p = t.supplier.select(F.col("s_suppkey").alias("suppkey"), (F.col("s_nationkey") * 3.0 - 36).alias("lat"), ((F.col("s_suppkey") % 36) * 10.0 - 180).alias("lon"), F.col("s_acctbal").alias("v"))
    return p.select(
        "suppkey", F.round(X.haversine_km("lat", "lon", F.lit(50.0), F.lit(8.0)), 4).alias("km"), F.round(X.shortest_arc("lon", F.lit(170.0)), 4).alias("arc"),
        F.round(F.degrees(F.atan2("lat", "lon")), 6).alias("heading"), F.round(X.logistic(F.col("v") / 1000), 6).alias("logistic"), F.round(X.expected_margin("v", F.lit(0.0)), 6).alias("margin"),
    )


#: Close names, in SQL.
CLOSE_NAMES = """
WITH n AS (SELECT p_name AS name, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_name IS NOT NULL GROUP BY 1)
SELECT a.k AS a, b.k AS b, a.n AS n_a, b.n AS n_b, 1 AS d FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 1 AND levenshtein(a.name, b.name) = 1
UNION ALL SELECT k, k, n, n, 0 FROM n WHERE n > 1
"""


@query(CLOSE_NAMES)
def fuzzy_levenshtein(t: Tables):
    """Close names of all parts, as ``fuzzy_levenshtein_all``, under the name of the operator."""
    return fuzzy_levenshtein_all(t)


@query(CLOSE_NAMES)
def fuzzy_levenshtein_all(t: Tables):
    """Close names of the whole table: pairs of different names one edit apart (by the first part of each, with the number of parts), and
    names that several parts have, with themselves. One edit apart means a common text with at most one letter deleted, so such variants block exactly."""
    n = t.part.filter("p_name is not null").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    cut = "transform(sequence(1, length(name)), i -> concat(substring(name, 1, i - 1), substring(name, i + 1)))"
    v = n.withColumn("v", F.explode(F.expr(f"array_distinct(concat(array(name), if(length(name) > 0, {cut}, array())))")))
    a, b = v.selectExpr("v", "name as x", "k as a", "n as n_a"), v.selectExpr("v", "name as y", "k as b", "n as n_b")
    pairs = a.join(b, "v").filter("x < y").drop("v").distinct().withColumn("d", F.levenshtein("x", "y")).filter("d = 1").select("a", "b", "n_a", "n_b", "d")
    return pairs.unionByName(n.filter("n > 1").selectExpr("k as a", "k as b", "n as n_a", "n as n_b", "0 as d"))
