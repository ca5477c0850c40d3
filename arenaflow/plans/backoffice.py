"""Back-office questions: divisions, reigns, funnels, runs, documents, changes, duplicates; order = match, supplier or customer = participant."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.functions import names as N
from arenaflow.operators import joins, windows
from arenaflow.plans.registry import Tables, query
from arenaflow.sources import outputs


@query("""
WITH p AS (SELECT l_suppkey AS s, avg(l_quantity) AS q, sum(l_extendedprice) / sum(l_quantity) AS pr, avg(l_discount) AS d FROM lineitem GROUP BY 1 HAVING count(*) >= 10),
j AS (SELECT *, CASE WHEN s_acctbal >= 7500 THEN 'first' WHEN s_acctbal >= 2500 THEN 'second' ELSE 'third' END AS division FROM p JOIN supplier ON s = s_suppkey)
SELECT division, count(*) AS players, round(avg(q) + 1e-9, 4) AS quantity, round(min(q) + 1e-9, 4) AS quantity_low, round(max(q) + 1e-9, 4) AS quantity_high,
 round(avg(pr) + 1e-9, 4) AS price, round(min(pr) + 1e-9, 4) AS price_low, round(max(pr) + 1e-9, 4) AS price_high, round(avg(d) + 1e-9, 4) AS discount FROM j GROUP BY 1
""")
def division_averages(t: Tables):
    """Averages of the divisions and the ranges of their members' averages: participants are aggregated once, then their divisions."""
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.avg("l_quantity").alias("quantity"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.avg("l_discount").alias("discount"), F.count("*").alias("n")).filter("n >= 10")
    division = F.when(F.col("s_acctbal") >= 7500, "first").when(F.col("s_acctbal") >= 2500, "second").otherwise("third")
    ranges = [X.rounded(f(c), 4).alias(c + end) for c in ("quantity", "price") for f, end in ((F.avg, ""), (F.min, "_low"), (F.max, "_high"))]
    return p.join(t.supplier.select("s_suppkey", division.alias("division")), "s_suppkey").groupBy("division").agg(
        F.count("*").alias("players"), *ranges, X.rounded(F.avg("discount"), 4).alias("discount"))


@query("""
WITH m AS (SELECT c_nationkey AS server, CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, o_custkey AS c, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
k AS (SELECT server, mon, arg_max(c, {'n': n, 'c': -c}) AS king FROM m GROUP BY 1, 2),
b AS (SELECT *, CAST(king <> lag(king) OVER w AS INT) AS b FROM k WINDOW w AS (PARTITION BY server ORDER BY mon)),
i AS (SELECT *, sum(coalesce(b, 0)) OVER (PARTITION BY server ORDER BY mon ROWS UNBOUNDED PRECEDING) AS reign FROM b)
SELECT server, king, min(mon) AS since, max(mon) AS until, count(*) AS months FROM i GROUP BY server, reign, king
""")
def reigns(t: Tables):
    """Who stood first on a server in consecutive listed months, and for how long."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("server"))
    m = t.orders.select("o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("mon")).join(c, "o_custkey").groupBy("server", "mon", "o_custkey").agg(F.count("*").alias("n"))
    k = m.groupBy("server", "mon").agg(F.max_by("o_custkey", F.struct("n", -F.col("o_custkey"))).alias("king"))
    runs = windows.islands(k, ["server"], "mon", F.col("king") != F.lag("king").over(W.partitionBy("server").orderBy("mon")), "reign")
    return runs.groupBy("server", "reign", "king").agg(F.min("mon").alias("since"), F.max("mon").alias("until"), F.count("*").alias("months")).drop("reign")


@query("""
WITH o AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1)
SELECT c_nationkey AS server, count(*) AS known, count(n) AS seen, count(*) FILTER (n >= 10) AS regular, count(*) FILTER (n >= 10 AND u >= 3) AS core FROM customer LEFT JOIN o ON c = c_custkey GROUP BY 1
""")
def funnel(t: Tables):
    """Participants by stage: known, seen, regular, core."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    regular = F.col("n") >= 10
    return t.customer.select("c_custkey", F.col("c_nationkey").alias("server")).join(o, "c_custkey", "left").groupBy("server").agg(
        F.count("*").alias("known"), F.count("n").alias("seen"), F.count_if(regular).alias("regular"), F.count_if(regular & (F.col("u") >= 3)).alias("core"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, epoch_us(ts) AS tm, value, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS deaths FROM events),
r AS (SELECT user_id, day, count(*) AS steps, max(tm) - min(tm) AS lasted, round(sum(value) + 1e-9, 4) AS taken FROM d WHERE deaths = 0 GROUP BY 1, 2)
SELECT user_id, day, steps, lasted, taken, row_number() OVER (PARTITION BY user_id ORDER BY steps DESC, lasted, day) AS place FROM r QUALIFY place <= 5
""")
def opening_runs(t: Tables):
    """What each participant does from a day's start up to the first death, and the five longest of these runs."""
    return windows.opening_runs(
        t.events.select("user_id", F.to_date("ts").alias("day"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value", (F.col("event_type") == "error").alias("died")),
        ["user_id", "day"], ["at", "event_id"], "died", [(F.max("at") - F.min("at")).alias("lasted"), X.rounded(F.sum("value"), 4).alias("taken")],
    ).withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("steps"), "lasted", "day"))).filter("place <= 5")


@query("""
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, max(value) AS peak, count(*) FILTER (event_type = 'error') AS deaths, count(*) FILTER (event_type = 'purchase') AS items FROM events GROUP BY 1, 2)
SELECT user_id, hour, n, peak, CASE WHEN deaths > 0 AND items > 0 THEN 'trade' WHEN deaths > 0 THEN 'death' WHEN items > 0 THEN 'item' ELSE '' END AS note,
 (epoch_us(hour) - epoch_us(lag(hour) OVER (PARTITION BY user_id ORDER BY hour))) // 3600000000 AS idle FROM h
""")
def timeline(t: Tables):
    """A participant's buckets in order with what happened in each and the time since the one before."""
    h = t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("n"), F.max("value").alias("peak"), F.count_if(F.col("event_type") == "error").alias("deaths"), F.count_if(F.col("event_type") == "purchase").alias("items"))
    died, took = F.col("deaths") > 0, F.col("items") > 0
    note = F.when(died & took, "trade").when(died, "death").when(took, "item").otherwise("")
    seconds = F.unix_seconds(F.col("hour").cast("timestamp"))
    idle = F.floor((seconds - F.lag(seconds).over(W.partitionBy("user_id").orderBy("hour"))) / 3600)
    return h.select("user_id", "hour", "n", "peak", note.alias("note"), idle.alias("idle"))


@query("""
WITH a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'purchase')
SELECT user_id, i AS place, a.event_id AS left_id, b.event_id AS right_id, round(b.value - a.value, 4) AS gap FROM a JOIN b USING (user_id, i)
""")
def positional_zip(t: Tables):
    """Row i of one sequence beside row i of another; what is longer loses its end."""
    side = lambda kind, name: t.events.filter(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias("id"), F.col("event_id").alias(f"{name}_id"), F.col("value").alias(f"{name}_value"))
    z = joins.zipped(side("click", "left"), side("purchase", "right"), ["user_id"], ["ts", "id"], "place")
    return z.select("user_id", "place", "left_id", "right_id", F.round(F.col("right_value") - F.col("left_value"), 4).alias("gap"))


@query("""
SELECT user_id, count(DISTINCT CAST(ts - INTERVAL 6 HOUR AS DATE)) AS evenings, min(CAST(ts - INTERVAL 6 HOUR AS DATE)) AS first_evening FROM events GROUP BY 1
""")
def evenings(t: Tables):
    """Evenings on which someone played: what is played before six counts for the day before."""
    return t.events.groupBy("user_id").agg(F.countDistinct(X.evening("ts")).alias("evenings"), F.min(X.evening("ts")).alias("first_evening"))


@query("""
WITH n AS (SELECT o_custkey AS c, o_orderstatus AS mode, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT c AS custkey, CAST(to_json({'custkey': c, 'matches': CAST(sum(n) AS BIGINT), 'modes': list({'mode': mode, 'n': n} ORDER BY mode)}) AS VARCHAR) AS document FROM n GROUP BY 1
""")
def player_documents(t: Tables):
    """One JSON document for each participant."""
    n = t.orders.groupBy(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("mode")).agg(F.count("*").alias("n"))
    d = n.groupBy("custkey").agg(F.sum("n").alias("matches"), F.array_sort(F.collect_list(F.struct("mode", "n"))).alias("modes"))
    return outputs.documents(d, "custkey", ["matches", "modes"])


@query("""
WITH h AS (SELECT event_id, user_id, ts, sha256(to_json({'event_type': event_type, 'props': props})) AS h FROM events)
SELECT event_id, h AS input_hash, coalesce(h <> lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS stale FROM h
""")
def input_changes(t: Tables):
    """Whether what a cached text was made from has changed since the record before."""
    e = t.events.select("event_id", "user_id", "ts", X.content_hash("event_type", "props").alias("input_hash"))
    before = F.lag("input_hash").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", "input_hash", F.coalesce(F.col("input_hash") != before, F.lit(True)).alias("stale"))


@query("""
WITH b AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages), g AS (SELECT name, min(page_id) FILTER (page_id % 2 = 0) AS kept FROM b GROUP BY 1 HAVING count(*) > 1 AND kept IS NOT NULL)
SELECT page_id AS dropped, kept FROM b JOIN g USING (name) WHERE page_id <> kept
""")
def epoch_duplicates(t: Tables):
    """Records of the same file: the first of the newer numbering (even ids) stays, the others go."""
    b = t.pages.select("page_id", N.basename("url").alias("name"))
    kept = F.min(F.when(F.col("page_id") % 2 == 0, F.col("page_id")))
    g = b.groupBy("name").agg(kept.alias("kept"), F.count("*").alias("n")).filter("n > 1 and kept is not null").drop("n")
    return b.join(g, "name").filter("page_id <> kept").select(F.col("page_id").alias("dropped"), "kept")


@query("""
SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links,
 TRY_CAST(regexp_extract(html, '([0-9]+)', 1) AS BIGINT) AS first_number FROM pages
""")
def html_fields(t: Tables):
    """Fields scraped from raw pages; a number that isn't there (or too large) is null."""
    count = lambda tag: F.regexp_count("html", F.lit(tag)).cast("long")
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return t.pages.select("page_id", title.alias("title"), count("<p>").alias("paragraphs"), count("<a ").alias("links"), F.regexp_extract("html", "([0-9]+)", 1).try_cast("long").alias("first_number"))


@query("""
SELECT c_custkey AS custkey, lower(c_name) AS norm,
 CASE c_custkey % 3 WHEN 1 THEN '(' || c_name || ')' WHEN 0 THEN 'au.' || c_name ELSE c_name END AS display,
 '-=\\1[' || CASE c_custkey % 3 WHEN 0 THEN 'au.' WHEN 1 THEN '(' ELSE '' END || c_name || CASE WHEN c_custkey % 3 = 1 THEN ')' ELSE ' \\5_' END AS stored
FROM customer
""")
def name_forms(t: Tables):
    """The stored, the canonical and the shown form of decorated names."""
    kind = F.col("c_custkey") % 3
    front = F.when(kind == 0, "au.").when(kind == 1, "(").otherwise("")
    raw = F.concat(F.lit("-=\x10"), front, F.col("c_name"), F.when(kind == 1, ")").otherwise(" \xdf"))
    named = t.customer.select(F.col("c_custkey").alias("custkey"), raw.alias("raw"))
    return named.select("custkey", N.normalised("raw").alias("norm"), N.for_display("raw").alias("display"), N.escaped("raw").alias("stored"))
