"""Timed steps of a ladder's challenges, re-resolving of matches and previews. Every step is a function of the tables and a given now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import ladder

#: Minutes before a match at which its two reminders are due, days until the nudge and until a pending report is given up,
#: minutes a series must have been over before it is resolved.
HOUR_BEFORE, SOON_BEFORE, NUDGE_DAYS, REPORT_DAYS, SETTLE_MINUTES = (12, 70), (0, 12), 3, 3, 10


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_seconds(later) - F.unix_seconds(earlier)) / 60


def available(slot: Column, zone: Column, hours: Column) -> Column:
    """Whether the slot's local hour of the week (Sunday 0 h is 0) is among ``hours``."""
    local = F.from_utc_timestamp(slot, F.coalesce(zone, F.lit("UTC")))
    return F.array_contains(hours, (F.dayofweek(local) - 1) * 24 + F.hour(local))


def auto_picks(challenges: DataFrame, members: DataFrame, picks: DataFrame, availability: DataFrame, now: Column) -> DataFrame:
    """id, member, slots: the picks made by hand, and for members without any, who opted in, the proposed future slots at which they
    are free. ``challenges``: id, proposed; ``members``: id, member; ``picks``: id, member, slots; ``availability``: member, opted, zone,
    hours. Members with no slot have no row."""
    by_hand = picks.filter("size(slots) > 0")
    open_ = members.join(by_hand.select("id", "member"), ["id", "member"], "left_anti")
    free = open_.join(challenges.select("id", "proposed"), "id").join(availability.filter("opted"), "member")
    slots = F.filter("proposed", lambda s: (s > now) & available(s, F.col("zone"), F.col("hours")))
    return by_hand.select("id", "member", "slots").unionByName(free.select("id", "member", slots.alias("slots")).filter("size(slots) > 0"))


def agreed(members: DataFrame, picks: DataFrame, now: Column) -> DataFrame:
    """id, slot: the earliest future slot that every member picked; challenges without one have no row."""
    future = picks.withColumn("slots", F.filter("slots", lambda s: s > now))
    every = members.join(future, ["id", "member"], "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<timestamp>")))
    return ladder.common_slot(every).filter("slot is not null")


def due(challenges: DataFrame, fired: DataFrame, now: Column) -> DataFrame:
    """id, kind of every reminder that is due and hasn't been sent. ``challenges``: id, status, agreed_at, created_at, deadline;
    ``fired``: id, kind."""
    ahead = minutes_between(F.col("agreed_at"), now)
    planned, unplanned = F.col("status") == "scheduled", F.col("status") == "open"
    kinds = F.array(
        F.when(planned & (ahead > HOUR_BEFORE[0]) & (ahead <= HOUR_BEFORE[1]), "hour"),
        F.when(planned & (ahead > SOON_BEFORE[0]) & (ahead <= SOON_BEFORE[1]), "soon"),
        F.when(unplanned & (minutes_between(now, F.col("created_at")) > NUDGE_DAYS * 1440) & (F.col("deadline") > now), "nudge"),
        F.when(unplanned & (F.col("deadline") <= now), "overdue"),
    )
    all_due = challenges.select("id", F.explode(F.array_compact(kinds)).alias("kind"))
    return all_due.join(fired.select("id", "kind"), ["id", "kind"], "left_anti")


def expired(challenges: DataFrame, now: Column) -> DataFrame:
    """id, step of open challenges past their deadline: review (unless the ladder forfeits by itself), cancel (the challenged team made
    the last offer, so the challenger let it lapse), else forfeit. ``challenges``: id, status, deadline, challenged_id, proposed_by,
    auto_forfeit."""
    late = challenges.filter((F.col("status") == "open") & (F.col("deadline") <= now))
    step = F.when(~F.coalesce("auto_forfeit", F.lit(False)), "review").when(F.col("proposed_by") == F.col("challenged_id"), "cancel").otherwise("forfeit")
    return late.select("id", step.alias("step"))


def report_steps(reports: DataFrame, now: Column) -> DataFrame:
    """report_id, step of pending reports: cancelled if the challenge is settled otherwise or the report has waited too long, recorded if
    its games are there and decide the match, review if they are there and don't, else pending. ``reports``: report_id, challenge_status,
    wanted, found, decided, created_at."""
    waited = minutes_between(now, F.col("created_at")) > REPORT_DAYS * 1440
    step = (
        F.when(~F.col("challenge_status").isin("open", "scheduled"), "cancelled")
        .when((F.col("found") == F.col("wanted")) & F.col("decided"), "recorded")
        .when(F.col("found") == F.col("wanted"), "review")
        .when(waited, "cancelled")
        .otherwise("pending")
    )
    return reports.select("report_id", step.alias("step"))


def settled(series: DataFrame, now: Column) -> DataFrame:
    """Series whose last game is over for long enough that none can still be missing."""
    return series.filter(minutes_between(now, F.col("last_played")) >= SETTLE_MINUTES)


def without_match(movements: DataFrame, match_ids: list[int]) -> DataFrame:
    """team_id, rung as if some matches hadn't been: a log of movements needs no undoing, it is folded again without theirs.
    Movements without a match stay."""
    return ladder.standings(movements.filter(F.col("match_id").isNull() | ~F.col("match_id").isin(match_ids)))


def recomputed(matches: DataFrame, players: DataFrame, rosters: DataFrame) -> DataFrame:
    """id and maps of matches with scores summed anew from the current rosters; the winner stays as stored.

    ``matches``: id, team_a_id, team_b_id, maps (array of game_id, arena, a_frags, b_frags); ``players``: game_id, player, frags;
    ``rosters``: team_id, player. A side without a player in the game keeps its score."""
    games = matches.select("id", "team_a_id", "team_b_id", F.posexplode("maps").alias("n", "m")).select("id", "team_a_id", "team_b_id", "n", "m.*")
    sides = games.select("id", "n", "game_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"team_{s}_id").alias("team_id")) for s in "ab"])).alias("s"))
    scored = sides.select("id", "n", "game_id", "s.*").join(rosters, "team_id").join(players, ["game_id", "player"])
    sums = scored.groupBy("id", "n").agg(*[F.sum(F.when(F.col("side") == s, F.col("frags"))).alias(f"new_{s}") for s in "ab"])
    fresh = games.join(sums, ["id", "n"], "left")
    row = F.struct("n", "game_id", "arena", *[F.coalesce(f"new_{s}", f"{s}_frags").alias(f"{s}_frags") for s in "ab"])
    again = fresh.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("m"))
    return again.select("id", F.transform("m", lambda x: x.dropFields("n")).alias("maps"))


def preview(challenges: DataFrame, games: DataFrame, strength: DataFrame) -> DataFrame:
    """id, meetings, probability (the challenger's), line_a, line_b, maps (expected) and total (expected frags, to the half).

    ``challenges``: id, a, b; ``games``: a, b, a_frags, b_frags of past meetings in either order; ``strength``: team, efficiency, frags.
    With meetings the mean of map and frag shares counts, drawn to a half by 4 maps; without, a flat function of strengths. Missing strengths
    are 50 and 0 (50 frags in the total)."""
    turned = games.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_frags").alias("a_frags"), F.col("a_frags").alias("b_frags"))
    g = games.select(*turned.columns).unionByName(turned).filter("a_frags is not null and b_frags is not null").groupBy("a", "b").agg(
        F.count_if(F.col("a_frags") > F.col("b_frags")).alias("won"), F.count_if(F.col("a_frags") < F.col("b_frags")).alias("lost"), F.sum("a_frags").alias("f"), F.sum("b_frags").alias("h")
    )
    side = lambda s: strength.select(F.col("team").alias(s), F.col("efficiency").alias(f"e_{s}"), F.col("frags").alias(f"f_{s}"))
    c = challenges.select("id", "a", "b").join(g, ["a", "b"], "left").join(side("a"), "a", "left").join(side("b"), "b", "left")
    n = F.coalesce(F.col("won") + F.col("lost"), F.lit(0))
    share = 0.5 * F.try_divide(F.col("won"), n) + 0.5 * F.coalesce(F.try_divide(F.col("f"), F.col("f") + F.col("h")), F.lit(0.5))
    or_else = lambda x, d: F.coalesce(x, F.lit(float(d)))
    signal = (or_else("e_a", 50) - or_else("e_b", 50)) / 10 + (or_else("f_a", 0) - or_else("f_b", 0)) / 40
    flat = 0.5 + 0.5 * (X.logistic(0.4 * signal) - 0.5)
    raw = F.when(n > 0, 0.5 + n / (n + 4.0) * (share - 0.5)).otherwise(flat)
    c = c.withColumns({"meetings": n, "probability": F.greatest(F.lit(0.15), F.least(F.lit(0.85), raw))})
    p = F.col("probability")
    a_map = F.when(F.col("meetings") > 0, (F.col("f") + F.col("h")) / F.col("meetings")).otherwise(or_else("f_a", 50) + or_else("f_b", 50))
    return c.select(
        "id", "meetings", F.round(p, 6).alias("probability"), X.market_line(p).alias("line_a"), X.market_line(1 - p).alias("line_b"),
        F.round(X.expected_maps(p), 6).alias("maps"), (F.bround(a_map * X.expected_maps(p) * 2) / 2).alias("total"),
    )


#: Days of a weekly grid, Monday first, and the last hour of a row: 24 to 26 are the hours after midnight of that night.
DAYS, LAST_HOUR = ("mon", "tue", "wed", "thu", "fri", "sat", "sun"), 26


def clean_availability(grid: Column | str) -> Column:
    """A weekly grid (map of day to array of hours) with known days and hours 0 to LAST_HOUR only, each once and in order; days without hours go, and a
    grid without days is null."""
    grid = F.col(grid) if isinstance(grid, str) else grid
    hours = F.transform_values(grid, lambda _, hs: F.array_sort(F.array_distinct(F.filter(F.coalesce(hs, F.array().cast("array<int>")), lambda h: h.between(0, LAST_HOUR)))))
    kept = F.map_filter(hours, lambda d, hs: d.isin(*DAYS) & (F.size(hs) > 0))
    return F.when(F.size(kept) > 0, kept)


def grid_hour(slot: Column | str, zone: Column | str | None = None) -> Column:
    """(day, hour) of a weekly grid for an instant (UTC) in a zone: the hours to two in the morning belong to the day before, as 24 to 26."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    zone = F.lit("America/New_York") if zone is None else F.coalesce(F.col(zone) if isinstance(zone, str) else zone, F.lit("America/New_York"))
    local = F.convert_timezone(F.lit("UTC"), zone, slot)
    night = F.hour(local) <= 2
    day = F.pmod(F.dayofweek(local) + F.lit(5) - night.cast("int"), F.lit(7))
    names = F.array(*[F.lit(d) for d in DAYS])
    return F.struct(F.element_at(names, (day + 1).cast("int")).alias("day"), (F.hour(local) + F.when(night, 24).otherwise(0)).cast("int").alias("hour"))


def in_availability(slot: Column | str, zone: Column | str | None, grid: Column | str) -> Column:
    """Whether a weekly grid holds an instant; false without a grid or an instant."""
    at = grid_hour(slot, zone)
    grid = F.col(grid) if isinstance(grid, str) else grid
    return F.coalesce(F.array_contains(F.element_at(grid, at["day"]), at["hour"]), F.lit(False))
