"""Frame-level telemetry: holdings of a resource, acquisition times, first intent, movement cards, attempts.

Every operator is made of windows over one participant's frames, or of joins on derived ticks; nothing runs in grouped Python. A
window holds the frames of one match and participant, which the length of a match bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import aggs, joins

#: A resource lost within QUICK seconds of being taken returns SOON seconds after the taking, else LATE after its loss.
QUICK, SOON, LATE = 4.0, 25.0, 20.0
#: Frames traced after a spawn, distance of a touch, distance of a meaningful approach, armour of a stacked spawn.
TRACE, TOUCH, APPROACH, STACKED = 60, 60.0, 160.0, 50


def holdings(frames: DataFrame, keys: list[str], who: str, at: str, held: Column) -> DataFrame:
    """keys, who, start, stop of every run of frames for which ``held`` is true; stop is the frame after the run (or one past the last)."""
    w = W.partitionBy(*keys, who).orderBy(at)
    on = frames.select(*keys, who, at, F.coalesce(held, F.lit(False)).alias("on"))
    edge = (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int")
    run = F.sum("edge").over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = on.withColumns({"edge": edge, "after": F.coalesce(F.lead(at).over(w), F.col(at) + 1)}).withColumn("run", run)
    return marked.filter("on").groupBy(*keys, who, "run").agg(F.min(at).alias("start"), F.max("after").alias("stop")).drop("run")


def grabs(held: DataFrame, keys: list[str], who: str, second: float, quick: float = QUICK, soon: float = SOON, late: float = LATE) -> DataFrame:
    """Every holding but a match's first, with the time at which the resource was free again and the latency of the grab in seconds;
    ``second`` is a second in units of start. Holdings that start together go by ``who``."""
    w = W.partitionBy(*keys).orderBy("start", who)
    was = held.withColumns({"from": F.lag("start").over(w), "to": F.lag("stop").over(w)}).filter("from is not null")
    free = F.when((F.col("to") - F.col("from")) / second < quick, F.col("from") / second + soon).otherwise(F.col("to") / second + late)
    return was.withColumn("latency", F.greatest(F.col("start") / second - free, F.lit(0.0))).drop("from", "to")


def resource_control(frames: DataFrame, keys: list[str], who: str, at: str, held: Column, second: float) -> DataFrame:
    """keys, who, taken, total, control and the (upper) median latency of each participant's grabs."""
    g = grabs(holdings(frames, keys, who, at, held), keys, who, second)
    own = g.groupBy(*keys, who).agg(F.count("*").alias("taken"), aggs.upper_median("latency").alias("latency"))
    total = F.sum("taken").over(W.partitionBy(*keys))
    return own.withColumn("total", total).withColumn("control", F.col("taken") / F.col("total"))


def acquisitions(frames: DataFrame, keys: list[str], at: str, engaged: Column, off: Column, near: float = 5.0, most: float = 1000.0) -> DataFrame:
    """keys, seen, acquired, took: from the frame at which a target comes into view (``engaged`` becomes true while ``off`` exceeds ``near``)
    to the first frame with ``off`` below ``near``. A new view restarts the clock, a frame without ``off`` ends it, and so does the first
    frame more than ``most`` after the view."""
    w = W.partitionBy(*keys).orderBy(at)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    f = frames.select(*keys, at, off.alias("off"), F.when(off.isNull(), False).otherwise(F.coalesce(engaged, F.lit(False))).alias("in"))
    f = f.withColumns({"part": F.count_if(F.col("off").isNull()).over(so_far), "was": F.coalesce(F.lag("in").over(w), F.lit(False)), "before": F.lag(at).over(w)})
    view = F.when(F.col("in") & ~F.col("was") & (F.col("off") > near), F.col(at))
    clock = W.partitionBy(*keys, "part").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    f = f.withColumn("seen", F.last(view, ignorenulls=True).over(clock)).filter("seen is not null")
    hit = f.filter((F.col("off") < near) & (F.col("before") - F.col("seen") <= most))
    return hit.groupBy(*keys, "seen").agg(F.min(at).alias("acquired")).withColumn("took", F.col("acquired") - F.col("seen"))


def confirmed(found: DataFrame, hits: DataFrame, keys: list[str], at: str, most: float = 1000.0) -> DataFrame:
    """Acquisitions that a hit follows within ``most``; ``hits`` has the keys and ``at``."""
    until = found.withColumn("until", F.col("acquired") + most)
    good = joins.interval_join(until, hits.select(*keys, F.col(at).alias("hit_at")), keys, "acquired", "until", "hit_at", most)
    return good.groupBy(*keys, "seen", "acquired", "took").agg(F.min("hit_at").alias("hit_at"))


def first_intent(frames: DataFrame, spawns: DataFrame, items: DataFrame) -> DataFrame:
    """match, player, armor_first, weapon_first, excluded, rate: what a participant goes for after a spawn.

    ``frames``: match, arena, player, tick, x, y, armor_value, alive; ``spawns``: match, player, tick of the first frame after each spawn;
    ``items``: arena, kind (armor or weapon), x, y. The trace ends with the life. The class touched first decides (armor if both at once),
    else the class approached most closely, if closely enough; other spawns count for nobody. Spawns with armour are excluded, repeated ones count once.
    Arenas without items of both kinds give no rows. The items of an arena are a bounded list."""
    placed = items.filter("x is not null and y is not null").groupBy("arena").agg(
        *[F.collect_list(F.when(F.col("kind") == k, F.struct("x", "y"))).alias(k) for k in ("armor", "weapon")]
    ).filter("size(armor) > 0 and size(weapon) > 0")
    steps = spawns.withColumn("spawn", F.col("tick")).withColumn("tick", F.explode(F.sequence(F.col("tick"), F.col("tick") + TRACE - 1)))
    trace = frames.join(steps, ["match", "player", "tick"]).join(placed, "arena")

    def nearest(kind: str) -> Column:
        return F.array_min(F.transform(kind, lambda p: F.hypot(F.col("x") - p["x"], F.col("y") - p["y"])))

    keys = ["match", "player", "spawn"]
    so_far = W.partitionBy(*keys).orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    trace = trace.withColumn("dead", F.max((~F.col("alive")).cast("int")).over(so_far)).withColumns({"near_armor": nearest("armor"), "near_weapon": nearest("weapon")})
    touch = F.when(F.col("near_armor") <= TOUCH, "armor").when(F.col("near_weapon") <= TOUCH, "weapon")
    live = F.col("dead") == 0
    spawn = trace.groupBy(*keys).agg(
        F.max(F.when(F.col("tick") == F.col("spawn"), F.col("armor_value") >= STACKED)).alias("stacked"),
        F.min_by(F.when(live, touch), F.when(live & touch.isNotNull(), F.col("tick"))).alias("touched"),
        F.min(F.when(live, F.col("near_armor"))).alias("to_armor"), F.min(F.when(live, F.col("near_weapon"))).alias("to_weapon"),
    )
    closest = F.when(F.least("to_armor", "to_weapon") <= APPROACH, F.when(F.col("to_armor") <= F.col("to_weapon"), "armor").otherwise("weapon"))
    chosen = spawn.withColumn("choice", F.when(~F.coalesce("stacked", F.lit(False)), F.coalesce("touched", closest)))
    out = chosen.groupBy("match", "player").agg(
        F.count_if(F.col("choice") == "armor").alias("armor_first"), F.count_if(F.col("choice") == "weapon").alias("weapon_first"), F.count_if("stacked").alias("excluded")
    )
    return out.filter("armor_first + weapon_first > 0").withColumn("rate", F.round(F.col("armor_first") / (F.col("armor_first") + F.col("weapon_first")), 3))


def movement_card(frames: DataFrame, keys: list[str], at: str, lags: tuple[int, ...] = (1, 4), least: int = 8) -> DataFrame:
    """A row for each of ``keys``: (upper) median speed, share of airborne frames and the correlation of heading and view turns over each lag.

    ``frames``: vx, vy, yaw (degrees), height. Speeds of 2500 and more are glitches; turns count above a speed of 320."""
    w = W.partitionBy(*keys).orderBy(at)
    speed, heading = F.hypot("vx", "vy"), F.degrees(F.atan2("vy", "vx"))
    f = frames.withColumns({"speed": speed, "heading": heading})
    turns = {}
    for k in lags:
        for c in ("heading", "yaw"):
            turns[f"{c}_{k}"] = F.when(F.col("speed") > 320, X.shortest_arc(F.col(c), F.lag(c, k).over(w)))
    f = f.withColumns(turns)
    return f.groupBy(*keys).agg(
        F.round(aggs.upper_median(F.when(F.col("speed") < 2500, F.col("speed")))).alias("speed_median"),
        # the product comes first: 100 * (23 / 80) is less than 28.75
        F.round(F.try_divide(100.0 * F.count_if(F.col("height") > 20), F.count("height")), 1).alias("airborne_pct"),
        *[F.round(aggs.corr_with_floor(f"heading_{k}", f"yaw_{k}", least), 3).alias(f"coupling_{k}") for k in lags],
    )


def fast_share(hits: DataFrame, frames: DataFrame, keys: list[str], width: float, fast: float = 450.0) -> DataFrame:
    """Share of dealt damage at a speed above ``fast``: hits (keys, time, damage) meet the frame of their nearest tick."""
    h = hits.filter("damage > 0").select(*keys, F.round(F.col("time") / width).cast("long").alias("tick"), "damage")
    joined = h.join(frames.select(*keys, "tick", F.hypot("vx", "vy").alias("speed")).filter("speed is not null"), [*keys, "tick"])
    done = F.sum(F.when(F.col("speed") > fast, F.col("damage")).otherwise(0))
    return joined.groupBy(*keys).agg(F.round(100 * done / F.sum("damage"), 1).alias("fast_share"))


def lift_offs(hits: DataFrame, frames: DataFrame, keys: list[str], width: float, span: int = 15, peak: float = 60.0, high: float = 20.0, least: int = 6) -> DataFrame:
    """keys, lift_offs: own hits (keys, id, time) after which the next ``span`` frames reach ``peak`` and ``least`` of them stand above ``high``."""
    start = F.round(F.col("time") / width).cast("long")
    steps = hits.select(*keys, "id", F.explode(F.sequence(start, start + span - 1)).alias("tick"))
    h = steps.join(frames.select(*keys, "tick", "height").filter("height > -100 and height < 5000"), [*keys, "tick"])
    each = h.groupBy(*keys, "id").agg(F.max("height").alias("top"), F.count_if(F.col("height") > high).alias("n"))
    return each.groupBy(*keys).agg(F.count_if((F.col("top") > peak) & (F.col("n") >= least)).alias("lift_offs"))


def jump_attempts(spikes: DataFrame, track: DataFrame, keys: list[str], span: float) -> DataFrame:
    """keys, start, top, peak_at, landed: the track within ``span`` after each spike; the first of equal peaks counts."""
    until = spikes.select(*keys, "start").withColumn("until", F.col("start") + span)
    seen = joins.interval_join(until, track.select(*keys, "at", "z", "on_ground"), keys, "start", "until", "at", span)
    return seen.groupBy(*keys, "start").agg(
        F.max("z").alias("top"), F.max_by("at", F.struct("z", -F.col("at"))).alias("peak_at"), F.bool_or(F.col("on_ground") & (F.col("at") > F.col("start"))).alias("landed")
    )


def levers(metrics: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Weaknesses by priority. ``metrics``: keys, metric, win, loss, overall; ``marks``: metric, elite, higher_better. The gap between won
    and lost matches counts 1.5, the gap to the mark 1, each as a share of the mark; only gaps for the worse count. ``marks`` is a list
    of metrics, checked to be short before it is sent to all tasks."""
    if marks.count() > 1000:
        raise ValueError("more marks than a list of metrics has")
    m = metrics.join(F.broadcast(marks), "metric")
    sign = F.when(F.col("higher_better"), 1.0).otherwise(-1.0)
    own = sign * (F.col("win") - F.col("loss"))
    gap = sign * (F.col("elite") - F.coalesce("overall", "loss"))
    base = F.when(F.col("elite") == 0, 1.0).otherwise(F.abs("elite"))
    score = 1.5 * F.greatest(F.coalesce(own / base, F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce(gap / base, F.lit(0.0)), F.lit(0.0))
    out = m.withColumns({"self_gap": own, "below": F.coalesce(gap > 0, F.lit(False)), "priority": F.round(score, 3)}).filter(own.isNotNull() | gap.isNotNull())
    return out.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("priority"), "metric")))


def opening_score(runs: DataFrame, marks: DataFrame, never: float = 12.0, tier: float = 0.6) -> DataFrame:
    """``runs`` with score: half efficiency, 0.3 result, 0.2 items. ``marks`` has samples (arena, own, enemy, seconds, items); those of the
    spawn pair are used if there are at least four, else those of the spawn. ``never`` stands for no time, ``tier`` for no items. Runs of
    an arena without samples go."""

    def mark(keys: list[str], tag: str) -> DataFrame:
        return marks.groupBy(*keys).agg(
            F.percentile("seconds", 0.5).alias(f"s_{tag}"), F.avg("items").alias(f"i_{tag}"), F.count("seconds").alias(f"ns_{tag}"), F.count("items").alias(f"ni_{tag}")
        )

    wide = ["arena", "own"]
    r = runs.join(marks.select("arena").distinct(), "arena", "left_semi").join(mark(wide, "wide"), wide, "left").join(mark([*wide, "enemy"], "fine"), [*wide, "enemy"], "left")

    def best(c: str, otherwise: float) -> Column:
        return F.coalesce(F.when(F.col(f"n{c}_fine") >= 4, F.col(f"{c}_fine")).otherwise(F.col(f"{c}_wide")), F.lit(otherwise))

    eff = F.least(F.lit(1.0), best("s", never) / F.greatest(F.coalesce("to_stack", F.lit(never)), F.lit(0.3)))
    item = F.least(F.lit(1.0), F.col("item_tier") / F.greatest(best("i", tier), F.lit(0.5)))
    return r.select(*runs.columns, F.round(0.5 * eff + 0.3 * F.col("result") + 0.2 * item, 6).alias("score"))


#: Fixed values of the track dials: the speed beyond which a step is a glitch, vertical speeds of the air and of a jump, the speed and least seconds of a pause,
#: the least speed at which a heading counts.
GLITCH, AIR, JUMP, STILL, PAUSE, MOVING = 5000.0, 40.0, 200.0, 30.0, 0.30, 50.0
#: Fixed value: the stack by which the best are ahead at their kills.
KILL_LEAD = 82


def track_dials(samples: DataFrame, keys: list[str], at: str) -> DataFrame:
    """A row for each of ``keys`` with two samples at least: frames, seconds, mean speed and its percentiles, share of steps in the air, jumps, pauses and
    their seconds, turn rate percentiles, and the correlation of view and heading rates with its number of pairs (0 for none or a constant side).

    ``samples``: x, y, z, yaw (degrees) at times in seconds. A step is from one sample to the next later one; steps that are too fast (a teleport) count for nothing
    but for breaking a heading. Equal times make no step."""
    w = W.partitionBy(*keys).orderBy(at)
    back = lambda c: F.lag(c).over(w)
    one = samples.groupBy(*keys).agg(F.count("*").alias("frames"), (F.max(at) - F.min(at)).alias("seconds")).filter("frames >= 2")
    s = samples.withColumns({"__dt": F.col(at) - back(at)} | {f"__d{c}": F.col(c) - back(c) for c in ("x", "y", "z", "yaw")}).filter("__dt > 0")
    s = s.withColumns({f"__v{c}": F.col(f"__d{c}") / F.col("__dt") for c in "xyz"}).withColumn("__turn", X.shortest_arc(F.col("__dyaw"), F.lit(0.0)) / F.col("__dt"))
    s = s.withColumn("__speed", F.hypot("__vx", "__vy"))
    s = s.withColumn("__fine", (F.col("__speed") <= GLITCH) & (F.abs("__vz") <= GLITCH))
    heading = F.when(F.col("__fine") & (F.col("__speed") >= MOVING), F.degrees(F.atan2("__vy", "__vx")))
    s = s.withColumn("__heading", heading).withColumn("__swing", X.shortest_arc(F.col("__heading"), back("__heading")) / F.col("__dt"))
    f = s.filter("__fine").withColumn("__up", F.col("__vz") > JUMP).withColumn("__slow", F.col("__speed") < STILL)
    f = f.withColumn("__jump", F.col("__up") & ~F.coalesce(F.lag("__up").over(w), F.lit(False)))
    f = f.withColumn("__stops", F.sum((~F.col("__slow")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = f.filter("__slow").groupBy(*keys, "__stops").agg(F.sum("__dt").alias("s")).filter(F.col("s") >= PAUSE)
    pauses = runs.groupBy(*keys).agg(F.count("*").alias("pauses"), F.sum("s").alias("paused"))
    both = F.col("__swing").isNotNull()
    dials = f.groupBy(*keys).agg(
        F.round(F.avg("__speed"), 2).alias("speed_mean"), *[F.round(F.percentile("__speed", p / 100), 2).alias(f"speed_p{p}") for p in (50, 95, 99)],
        F.round(100.0 * F.count_if(F.abs("__vz") > AIR) / F.count("*"), 1).alias("airborne_pct"), F.count_if("__jump").alias("jumps"),
        *[F.round(F.percentile(F.abs("__turn"), p / 100), 1).alias(f"turn_p{p}") for p in (50, 95)],
        F.round(F.coalesce(F.nanvl(F.corr(F.when(both, F.col("__turn")), F.col("__swing")), F.lit(0.0)), F.lit(0.0)), 3).alias("coupling"), F.count_if(both).alias("coupled"))
    out = one.join(dials, keys, "left").join(pauses, keys, "left")
    return out.withColumn("pauses", F.when(F.col("speed_mean").isNotNull(), F.coalesce("pauses", F.lit(0)))).withColumn("paused", F.when(F.col("speed_mean").isNotNull(), F.round(F.coalesce("paused", F.lit(0.0)), 2)))


def discipline(stacks: DataFrame) -> DataFrame:
    """The lever of picking fights: ``stacks`` with kill_lead, death_deficit, below and priority: how far the lead at one's kills lies below that of the best,
    counted twice. ``stacks``: own and enemy stack at kills and at deaths (own_kill, enemy_kill, own_death, enemy_death); rows without both at kills go."""
    lead = F.bround(F.col("own_kill") - F.col("enemy_kill"))
    rows = stacks.filter("own_kill is not null and enemy_kill is not null").withColumns({"kill_lead": lead, "death_deficit": F.bround(F.col("own_death") - F.col("enemy_death"))})
    gap = F.greatest(KILL_LEAD - F.col("kill_lead"), F.lit(0.0)) / KILL_LEAD
    return rows.withColumns({"below": F.col("kill_lead") < KILL_LEAD, "priority": F.round(gap * 2.0, 3)})


def win_split(games: DataFrame, keys: list[str], means: list[str], pooled: dict[str, tuple[str, str]]) -> DataFrame:
    """For each of ``keys`` the number of games, wins and losses, the mean of every measure over won, lost and all games (*_win, *_loss, *_all, to one
    digit), and the pooled rates sum / sum, so that every decision weighs the same and not every game. ``games``: result (W, L or other)."""
    parts = {"win": F.col("result") == "W", "loss": F.col("result") == "L", "all": F.lit(True)}
    cols = [F.count("*").alias("games"), F.count_if(parts["win"]).alias("wins"), F.count_if(parts["loss"]).alias("losses")]
    for part, where in parts.items():
        cols += [F.round(F.avg(F.when(where, F.col(m))) + 1e-9, 1).alias(f"{m}_{part}") for m in means]
        cols += [F.round(F.try_divide(F.sum(F.when(where, F.col(a))), F.sum(F.when(where, F.col(b)))) + 1e-9, 3).alias(f"{n}_{part}") for n, (a, b) in pooled.items()]
    return games.groupBy(*keys).agg(*cols)
