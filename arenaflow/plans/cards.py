"""Cards over frames: a user's events stand for frames, a day for a match."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import aggs, frames
from arenaflow.plans.registry import Tables, query


def micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, epoch_us(ts) AS tm, value > 100 AS held FROM events),
g AS (SELECT *, held AND NOT coalesce(lag(held) OVER w, false) AS edge, coalesce(lead(tm) OVER w, tm + 1) AS aft FROM e WINDOW w AS (PARTITION BY day, user_id ORDER BY tm)),
r AS (SELECT *, sum(edge::INT) OVER (PARTITION BY day, user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS run FROM g),
h AS (SELECT day, user_id, min(tm) AS start, max(aft) AS stop FROM r WHERE held GROUP BY day, user_id, run),
p AS (SELECT *, lag(start) OVER w AS f, lag(stop) OVER w AS t FROM h WINDOW w AS (PARTITION BY day ORDER BY start, user_id)),
l AS (SELECT day, user_id, greatest(start / 1e6 - CASE WHEN (t - f) / 1e6 < 4 THEN f / 1e6 + 25 ELSE t / 1e6 + 20 END, 0) AS lat FROM p WHERE f IS NOT NULL),
o AS (SELECT day, user_id, count(*) AS taken, list_sort(list(lat))[count(*) // 2 + 1] AS lat FROM l GROUP BY 1, 2)
SELECT day, user_id, taken, CAST(sum(taken) OVER (PARTITION BY day) AS BIGINT) AS total, round(taken / sum(taken) OVER (PARTITION BY day), 6) AS control, round(lat, 3) AS latency FROM o
""")
def resource_timing(t: Tables):
    """Who takes a returning resource how often, and how soon after its return."""
    e = t.events.select(F.to_date("ts").alias("day"), "user_id", micros().alias("at"), "value")
    c = frames.resource_control(e, ["day"], "user_id", "at", F.col("value") > 100, 1e6)
    return c.select("day", "user_id", "taken", "total", F.round("control", 6).alias("control"), F.round("latency", 3).alias("latency"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS tm, event_id, CASE WHEN event_type <> 'signup' THEN value END AS off, coalesce(event_type <> 'signup' AND value < 150, false) AS inn FROM events),
f AS (SELECT *, count(*) FILTER (off IS NULL) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS part, coalesce(lag(inn) OVER w, false) AS was, lag(tm) OVER w AS bef FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm)),
s AS (SELECT *, max(CASE WHEN inn AND NOT was AND off > 25 THEN tm END) OVER (PARTITION BY user_id, part ORDER BY tm ROWS UNBOUNDED PRECEDING) AS seen FROM f)
SELECT user_id, seen, min(tm) AS acquired, min(tm) - seen AS took FROM s WHERE seen IS NOT NULL AND off < 25 AND bef - seen <= 86400000 GROUP BY 1, 2
""")
def acquisition_times(t: Tables):
    """From a target's coming into view to its acquisition; frames without a target end the clock."""
    e = t.events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") != "signup", F.col("value")).alias("off"))
    return frames.acquisitions(e, ["user_id"], "at", F.col("off") < 150, F.col("off"), near=25.0, most=86_400_000.0)


@query("""
WITH f AS (SELECT user_id, epoch_us(ts) AS tm, value * 8 AS vx, value * 3 - 200 AS vy, value * 7 AS yaw, CASE WHEN event_type <> 'error' THEN value END AS height FROM events),
s AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, degrees(atan2(vy, vx)) AS heading FROM f),
d AS (SELECT *, CASE WHEN speed > 320 THEN heading - lag(heading) OVER w + 180 END AS h, CASE WHEN speed > 320 THEN yaw - lag(yaw) OVER w + 180 END AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tm)),
m AS (SELECT *, h - 360 * floor(h / 360) - 180 AS hh, y - 360 * floor(y / 360) - 180 AS yy FROM d)
SELECT user_id, round(list_sort(list(speed) FILTER (speed < 2500))[count(*) FILTER (speed < 2500) // 2 + 1]) AS speed_median,
 round(100.0 * count(*) FILTER (height > 20) / count(height), 1) AS airborne_pct, CASE WHEN count(*) FILTER (hh IS NOT NULL AND yy IS NOT NULL) >= 8 THEN round(corr(hh, yy), 3) END AS coupling_1 FROM m GROUP BY 1
""")
def movement_card(t: Tables):
    """Median speed, airborne share, coupling of heading and view."""
    v = F.col("value")
    f = t.events.select("user_id", micros().alias("at"), (v * 8).alias("vx"), (v * 3 - 200).alias("vy"), (v * 7).alias("yaw"), F.when(F.col("event_type") != "error", v).alias("height"))
    return frames.movement_card(f, ["user_id"], "at", lags=(1,))


@query("""
WITH m AS (SELECT l_suppkey AS s, l_quantity > 25 AS won, l_quantity AS q, l_extendedprice / 1000 AS p, l_discount * 100 AS d FROM lineitem),
u AS (SELECT s, won, unnest(['quantity', 'price', 'discount']) AS metric, unnest([q, p, d]) AS v FROM m),
a AS (SELECT s, metric, avg(v) FILTER (won) AS win, avg(v) FILTER (NOT won) AS loss, avg(v) AS overall FROM u GROUP BY 1, 2),
b AS (SELECT * FROM (VALUES ('quantity', 30.0, true), ('price', 60.0, true), ('discount', 4.0, false)) x(metric, elite, hb)),
g AS (SELECT s, metric, CASE WHEN hb THEN win - loss ELSE loss - win END AS own, CASE WHEN hb THEN elite - overall ELSE overall - elite END AS gap, elite FROM a JOIN b USING (metric)),
r AS (SELECT s, metric, gap > 0 AS below, round(1.5 * greatest(coalesce(own / elite, 0), 0) + greatest(gap / elite, 0), 3) AS priority FROM g)
SELECT s AS suppkey, metric, below, priority, row_number() OVER (PARTITION BY s ORDER BY priority DESC, metric) AS place FROM r
""")
def weakness_levers(t: Tables):
    """Means of won and lost rows against each other and against a mark, by priority."""
    m = t.lineitem.select(F.col("l_suppkey").alias("suppkey"), (F.col("l_quantity") > 25).alias("won"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_discount") * 100).alias("discount"))
    long = m.unpivot(["suppkey", "won"], ["quantity", "price", "discount"], "metric", "v")
    a = long.groupBy("suppkey", "metric").agg(F.avg(F.when(F.col("won"), F.col("v"))).alias("win"), F.avg(F.when(~F.col("won"), F.col("v"))).alias("loss"), F.avg("v").alias("overall"))
    marks = m.sparkSession.createDataFrame([("quantity", 30.0, True), ("price", 60.0, True), ("discount", 4.0, False)], "metric string, elite double, higher_better boolean")
    return frames.levers(a, marks, ["suppkey"]).select("suppkey", "metric", "below", "priority", "place")


@query("""
WITH r AS (SELECT event_id, user_id AS own, event_type AS enemy, value / 20 AS tts, (event_id % 5) / 4.0 AS tier FROM events),
m AS (SELECT own, median(tts) AS s, avg(tier) AS i FROM r GROUP BY 1), f AS (SELECT own, enemy, median(tts) AS s, avg(tier) AS i, count(*) AS n FROM r GROUP BY 1, 2)
SELECT r.event_id, round(0.5 * least(1, CASE WHEN n >= 4 THEN f.s ELSE m.s END / greatest(tts, 0.3)) + 0.3 * 0.5 + 0.2 * least(1, tier / greatest(CASE WHEN n >= 4 THEN f.i ELSE m.i END, 0.5)), 6) AS score
FROM r JOIN m USING (own) JOIN f USING (own, enemy)
""")
def opening_score(t: Tables):
    """Openings against the samples of the same spawn pair, or of the spawn where those are few."""
    v = t.events.select("event_id", F.lit("a").alias("arena"), F.col("user_id").alias("own"), F.col("event_type").alias("enemy"), (F.col("value") / 20).alias("to_stack"), ((F.col("event_id") % 5) / 4.0).cast("double").alias("item_tier"), F.lit(0.5).alias("result"))
    marks = v.select("arena", "own", "enemy", F.col("to_stack").alias("seconds"), F.col("item_tier").alias("items"))
    return frames.opening_score(v, marks).select("event_id", "score")


@query("""
WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS start FROM events WHERE event_type = 'error'), k AS (SELECT user_id, epoch_us(ts) / 1e6 AS tm, value AS z, event_type = 'click' AS g FROM events),
j AS (SELECT s.user_id, s.start, k.tm, k.z, k.g FROM s JOIN k ON s.user_id = k.user_id AND k.tm BETWEEN s.start AND s.start + 43200)
SELECT user_id, start, max(z) AS top, arg_max(tm, {'z': z, 'a': -tm}) AS peak_at, bool_or(g AND tm > start) AS landed FROM j GROUP BY 1, 2
""")
def jump_attempts(t: Tables):
    """The track after each spike: its peak, when, and whether it landed."""
    k = t.events.select("user_id", "event_type", (micros() / 1_000_000).alias("at"), F.col("value").alias("z"), (F.col("event_type") == "click").alias("on_ground"))
    return frames.jump_attempts(k.filter("event_type = 'error'").select("user_id", F.col("at").alias("start")), k, ["user_id"], 43_200.0)


@query("""
WITH p AS (SELECT user_id, event_type, count(*) AS n, corr(value, event_id) AS r FROM events GROUP BY 1, 2),
c AS (SELECT user_id, CASE WHEN count(*) >= 30 THEN round(corr(value, event_id), 6) END AS pooled FROM events GROUP BY 1)
SELECT c.user_id, pooled, CAST(count(*) FILTER (n >= 30) AS BIGINT) AS runs FROM c JOIN p USING (user_id) GROUP BY 1, 2
""")
def pooled_corr(t: Tables):
    """A statistic over the union of all runs beside the number of runs large enough for one of their own."""
    runs = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count_if(F.col("n") >= 30).alias("runs"))
    pooled = t.events.groupBy("user_id").agg(F.round(aggs.corr_with_floor("value", "event_id", 30), 6).alias("pooled"))
    return pooled.join(runs, "user_id").select("user_id", "pooled", "runs")


@query("""
WITH w AS (SELECT user_id, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM w)
SELECT user_id, max(n) AS days, round(avg(v) FILTER (i < n // 3) + 1e-9, 4) AS first_third, round(avg(v) FILTER (i >= n - n // 3) + 1e-9, 4) AS last_third, round(arg_max(v, i) - arg_min(v, i) + 1e-9, 4) AS change FROM n GROUP BY 1
""")
def thirds_trend(t: Tables):
    """First against last third of a series, and first against last value."""
    s = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    own = W.partitionBy("user_id")
    s = s.withColumns({"i": F.row_number().over(own.orderBy("d")) - 1, "n": F.count("*").over(own)})
    third = F.floor(F.col("n") / 3)
    return s.groupBy("user_id").agg(
        F.max("n").alias("days"), X.rounded(F.avg(F.when(F.col("i") < third, F.col("v"))), 4).alias("first_third"),
        X.rounded(F.avg(F.when(F.col("i") >= F.col("n") - third, F.col("v"))), 4).alias("last_third"), X.rounded(F.max_by("v", "i") - F.min_by("v", "i"), 4).alias("change"))


@query("""
WITH m AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1)
SELECT user_id, round(99 * greatest(0, 1 - greatest(40 - v, v - 55, 0) / 15), 6) AS score FROM m
""")
def band_scores(t: Tables):
    """How well a mean lies within a band."""
    m = t.events.groupBy("user_id").agg(F.avg("value").alias("v"))
    return m.select("user_id", X.band_score("v", 40.0, 55.0).alias("score"))
