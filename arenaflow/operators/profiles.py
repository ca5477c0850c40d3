"""Outcomes, statistics, profiles, rankings and comparisons of players.

Tables: ``players`` has a row for each match and player (match_id, player_name, canonical_id, player_team and the counts that the expressions
below name), ``matches`` match_id, match_mode, match_map, match_date, match_dmm, server_hostname. Expressions are SQL text, so that one list serves
every grouping.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.functions import formats
from arenaflow.functions.filters import SHIFTS, window
from arenaflow.operators import aggs, ranks, windows

#: Statistics of the leaderboards with their direction, format and expression over a row and its opponent (opp_*).
STATS = {
    "lg_pct": ("desc", "pct", "avg(player_lg_hits / nullif(player_lg_attacks, 0))"),
    "rl_pct": ("desc", "pct", "avg(player_rl_virtual / nullif(player_rl_attacks, 0))"),
    "frag_diff": ("desc", "plus1", "avg(player_frags - player_deaths)"),
    "ddr": ("desc", "ratio2", "sum(player_damage_given) / nullif(sum(player_damage_taken), 0)"),
    "net_dmg": ("desc", "plusnum", "avg(player_damage_given - player_damage_taken)"),
    "dmg_given": ("desc", "num0", "avg(player_damage_given)"),
    "dmg_taken": ("asc", "num0", "avg(player_damage_taken)"),
    "ra_pct": ("desc", "pct", "sum(player_ra_taken) / nullif(sum(player_ra_taken + coalesce(opp_ra, 0)), 0)"),
    "mh_pct": ("desc", "pct", "sum(player_health100_taken) / nullif(sum(player_health100_taken + coalesce(opp_mh, 0)), 0)"),
    "ya_pct": ("desc", "pct", "sum(player_ya_taken) / nullif(sum(player_ya_taken + coalesce(opp_ya, 0)), 0)"),
    "avg_frags": ("desc", "num1", "avg(player_frags)"),
    "avg_speed": ("desc", "num0", "avg(player_speed_avg)"),
    "spawnfrags_taken": ("asc", "num2", "avg(opp_spawnfrags)"),
}
#: The averages of a profile's slices.
AVERAGES = {
    "avg_frags": "player_frags", "avg_deaths": "player_deaths", "avg_frag_diff": "player_frags - player_deaths", "avg_teamkills": "player_teamkills",
    "avg_spawnfrags": "player_spawnfrags", "avg_suicides": "player_suicides", "avg_dmg_given": "player_damage_given", "avg_dmg_taken": "player_damage_taken",
    "avg_dmg_enemy_weapons": "player_damage_enemy_weapons", "avg_dmg_team": "player_damage_team", "rl_accuracy": "player_rl_virtual / nullif(player_rl_attacks, 0)",
    "lg_accuracy": "player_lg_hits / nullif(player_lg_attacks, 0)", "sg_accuracy": "player_sg_hits / nullif(player_sg_attacks, 0)",
    "ssg_accuracy": "player_ssg_hits / nullif(player_ssg_attacks, 0)", "avg_rl_dmg": "player_rl_damage_enemy", "avg_lg_dmg": "player_lg_damage_enemy",
    "avg_rl_kills": "player_rl_kills_enemy", "avg_lg_kills": "player_lg_kills_enemy", "avg_ra": "player_ra_taken", "avg_ya": "player_ya_taken", "avg_ga": "player_ga_taken",
    "avg_mh": "player_health100_taken", "avg_quads": "player_quad_taken", "avg_pents": "player_pent_taken", "avg_rl_taken": "player_rl_taken", "avg_lg_taken": "player_lg_taken",
    "avg_rl_dropped": "player_rl_dropped", "avg_lg_dropped": "player_lg_dropped", "avg_rl_transfer": "player_rl_transfer", "avg_lg_transfer": "player_lg_transfer",
    "avg_ping": "player_ping",
}
#: The columns that the expressions read.
COUNTS = sorted({"player_rl_directs"} | {w for text in [*AVERAGES.values(), *(s[2] for s in STATS.values())] for w in text.replace("(", " ").replace(")", " ").replace(",", " ").split() if w.startswith("player_")})
#: Axes of the skill profile and attributes of the cards.
AXES = {"lg_accuracy": STATS["lg_pct"][2], "rl_accuracy": STATS["rl_pct"][2], "avg_ddr": STATS["ddr"][2], "avg_frag_diff": STATS["frag_diff"][2], "avg_net_dmg": STATS["net_dmg"][2]}
CARDS = {
    "lg_acc": "sum(player_lg_hits) / nullif(sum(player_lg_attacks), 0)", "rl_acc": "sum(player_rl_virtual) / nullif(sum(player_rl_attacks), 0)",
    "ra_ctrl": STATS["ra_pct"][2], "mh_ctrl": STATS["mh_pct"][2],
}
LEFT_OUT = "3on3"
DUEL = "1on1"


def with_opponents(players: DataFrame, values: dict[str, str]) -> DataFrame:
    """Each row with columns of one other row of its match (null where there is none): of several the one with the smallest name. A match has few
    rows, so its window is small."""
    w = W.partitionBy("match_id")
    row = F.struct("player_name", *[F.col(c).alias(n) for n, c in values.items()])
    first = F.min(row).over(w)
    rows = players.withColumn("__first", first)
    rows = rows.withColumn("__second", F.min(F.when(F.col("player_name") != F.col("__first.player_name"), row)).over(w))
    other = lambda n: F.when(F.col("player_name") == F.col("__first.player_name"), F.col(f"__second.{n}")).otherwise(F.col(f"__first.{n}"))
    return rows.withColumns({n: other(n) for n in values}).drop("__first", "__second")


def team_results(players: DataFrame) -> DataFrame:
    """match_id, player_team, result: each team's total against the best of the others; none where it has no other."""
    totals = players.filter("player_team is not null").groupBy("match_id", "player_team").agg(F.sum("player_frags").alias("total"))
    w = W.partitionBy("match_id")
    top = totals.withColumn("__top", F.max("total").over(w)).withColumn("__tops", F.count_if(F.col("total") == F.col("__top")).over(w))
    second = F.max(F.when(F.col("total") < F.col("__top"), F.col("total"))).over(w)
    top = top.withColumn("__second", second)
    best = F.when((F.col("total") < F.col("__top")) | (F.col("__tops") > 1), F.col("__top")).otherwise(F.col("__second"))
    return top.select("match_id", "player_team", result("total", best).alias("result"))


def result(mine, theirs) -> Column:
    mine, theirs = (F.col(x) if isinstance(x, str) else x for x in (mine, theirs))
    return F.when(theirs.isNotNull(), F.when(mine > theirs, "win").when(mine < theirs, "loss").otherwise("draw"))


def outcomes(players: DataFrame, matches: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """Rows of all modes but LEFT_OUT with outcome (duels: against the other row; else team totals) and, in duels, opponent (an id), opponent_name and
    opponent_frags. ``identities``: canonical_id, display_name."""
    m = matches.filter(F.col("match_mode") != LEFT_OUT)
    values = {"__opp_id": "canonical_id", "__opp_name": "player_name", "__opp_frags": "player_frags", "opp_ra": "player_ra_taken", "opp_ya": "player_ya_taken", "opp_mh": "player_health100_taken", "opp_spawnfrags": "player_spawnfrags"}
    rows = with_opponents(players, values).join(m, "match_id").join(team_results(players), ["match_id", "player_team"], "left")
    duel = F.col("match_mode") == DUEL
    # a lone player of a duel has no other row and so no outcome; null frags on either side make a draw, as no comparison holds
    vs = F.when(F.col("__opp_name").isNotNull(), F.when(F.col("player_frags") > F.col("__opp_frags"), "win").when(F.col("player_frags") < F.col("__opp_frags"), "loss").otherwise("draw"))
    rows = rows.withColumn("outcome", F.when(duel, vs).otherwise(F.col("result"))).withColumn("opponent", F.when(duel, F.coalesce(F.col("__opp_id").cast("string"), "__opp_name")))
    rows = rows.withColumn("opponent_frags", F.when(duel, F.col("__opp_frags"))).withColumn("opponent_name", F.when(duel, F.coalesce(F.col("__opp_id").cast("string"), "__opp_name")))
    if identities is not None:
        shown = identities.select(F.col("canonical_id").alias("__opp_id"), F.col("display_name").alias("__shown"))
        rows = rows.join(shown, "__opp_id", "left").withColumn("opponent_name", F.when(duel, F.coalesce("__shown", "opponent_name"))).drop("__shown")
    return rows.drop("__opp_id", "__opp_name", "__opp_frags", "result")


def record() -> list[Column]:
    count = lambda o: F.count_if(F.col("outcome") == o)
    return [F.count("*").alias("matches"), count("win").alias("wins"), count("loss").alias("losses"), count("draw").alias("draws"), (count("win") / F.count("*")).alias("win_rate")]


def averages(names: list[str] | None = None) -> list[Column]:
    return [F.expr(f"avg({AVERAGES[n]})").alias(n) for n in names or AVERAGES]


#: What a profile is cut by: career, mode, map within a mode, mode and dmm, server, opponent of duels, week within a mode.
SLICES = {
    "career": [], "mode": ["match_mode"], "map": ["match_mode", "match_map"], "dmm": ["match_mode", "match_dmm"], "server": ["server"], "opponent": ["opponent"],
    "week": ["match_mode", "week"],
}


def profiles(rows: DataFrame, slices: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """canonical_id, slice, member (the cut's values, comma-joined), the record, all AVERAGES, first and last match and the mean margin over opponents, for
    every player and cut from one scan. Rows without a value of a cut's column don't belong to it. Rows are dealt once by player (in ``parts``) and meet
    their cuts there: most opponents and weeks have a row or two, whose sums would be wider than the rows and be shuffled for every cut."""
    slices = slices or list(SLICES)
    server = F.split_part(F.col("server_hostname"), F.lit(":"), F.lit(1))
    base = rows.filter("canonical_id is not null").withColumn("server", server).withColumn("week", X.iso_week("match_date")).withColumn("margin", F.col("player_frags") - F.col("opponent_frags"))
    dealt = base.repartition(*([parts] if parts else []), "canonical_id")

    def cut(s: str) -> Column:
        real = F.lit(True)
        for c in SLICES[s]:
            real = real & F.col(c).isNotNull()
        member = F.concat_ws(",", *[F.col(c).cast("string") for c in SLICES[s]]) if SLICES[s] else F.lit("")
        return F.when(real, F.struct(F.lit(s).alias("slice"), member.alias("member")))

    each = dealt.withColumn("__cut", F.explode(F.array_compact(F.array(*[cut(s) for s in slices]))))
    each = each.withColumns({"slice": F.col("__cut.slice"), "member": F.col("__cut.member")})
    return each.groupBy("canonical_id", "slice", "member").agg(*record(), *averages(), F.avg("margin").alias("avg_margin"), F.min("match_date").alias("first_match"), F.max("match_date").alias("last_match"))


def profile_change(rows: DataFrame, now: datetime, days: int, slices: tuple[str, ...] = ("mode", "opponent"), against: str = "prior") -> DataFrame:
    """canonical_id, slice, member and, for the record and AVERAGES, the value of the last ``days`` and ``*_before`` of the window that ``against`` names."""
    if against not in SHIFTS:
        raise ValueError(f"no window {against}")
    parts = []
    for shift in ("current", against):
        low, high = window(now, days, shift)
        at = F.col("match_date")
        parts.append(profiles(rows.filter((at >= F.lit(low).cast("timestamp_ntz")) & (at < F.lit(high).cast("timestamp_ntz"))), list(slices)))
    keys, measures = ["canonical_id", "slice", "member"], ["matches", "wins", "losses", "draws", "win_rate", *AVERAGES]
    before = parts[1].select(*keys, *[F.col(m).alias(f"{m}_before") for m in measures])
    return parts[0].select(*keys, *measures).join(before, keys, "full_outer")


def stat_table(players: DataFrame, matches: DataFrame, mode: str = DUEL, arena: str | None = None, since: datetime | None = None, least: int = 25) -> DataFrame:
    """canonical_id, matches and all STATS of the players with enough matches."""
    m = matches.filter(F.col("match_mode") == mode)
    if arena and arena != "all":
        m = m.filter(F.col("match_map") == arena)
    if since:
        m = m.filter(F.col("match_date") > F.lit(since).cast("timestamp_ntz"))
    rows = with_opponents(players, {"opp_ra": "player_ra_taken", "opp_ya": "player_ya_taken", "opp_mh": "player_health100_taken", "opp_spawnfrags": "player_spawnfrags"})
    rows = rows.filter("canonical_id is not null").join(m.select("match_id"), "match_id")
    return rows.groupBy("canonical_id").agg(F.count("*").alias("matches"), *[F.expr(s[2]).alias(n) for n, s in STATS.items()]).filter(F.col("matches") >= least)


def leaderboards(table: DataFrame, top: int = 5) -> DataFrame:
    """stat, place, canonical_id, value and formatted: the best of every statistic in its direction, ties to the smaller id."""
    best = windows.top_each(table, {n: s[0] for n, s in STATS.items()}, "canonical_id", top)
    text = F.lit(None).cast("string")
    for n, s in STATS.items():
        text = F.when(F.col("stat") == n, formats.formatted("value", s[1])).otherwise(text)
    return best.select("stat", "place", "canonical_id", "value", text.alias("formatted"))


def rankings(ratings: DataFrame, players: DataFrame, matches: DataFrame, now: datetime, mode: str = DUEL, least: int = 5, active: bool = False, limit: int | None = 500) -> DataFrame:
    """The ranking of a mode in one query: uncertainty as it is after idle days, who is provisional, tiers by place in the population, places among
    the others only. ``ratings``: canonical_id, mu, sigma, games, wins, opponents, hidden; hidden ones are left out, and so are those with fewer games
    than ``least`` (5 at least). By falling mu, then id."""
    played = players.filter("canonical_id is not null").join(matches.filter(F.col("match_mode") == mode).select("match_id", "match_date"), "match_id")
    recent = F.col("match_date") >= F.lit(now).cast("timestamp_ntz") - F.expr("interval 90 days")
    seen = played.groupBy("canonical_id").agg(F.max("match_date").alias("last_match"), F.count_if(recent).alias("recent"))
    r = ratings.filter((F.col("games") >= max(least, 5)) & ~F.coalesce("hidden", F.lit(False))).join(seen, "canonical_id", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
    cuts = aggs.cutoffs(ratings.filter("games >= 10"), "mu", X.TIER_SHARES).agg(F.array_sort(F.collect_list("cutoff")).alias("__cuts"))
    idle = F.greatest(F.coalesce(F.datediff(F.lit(now).cast("date"), F.to_date("last_match")), F.lit(0)), F.lit(0))
    r = r.withColumn("sigma_now", X.decayed_sigma("sigma", idle)).join(F.broadcast(cuts))  # one row
    r = r.withColumn("tier", F.when(F.size("__cuts") > 0, (F.size(F.filter("__cuts", lambda x: x > F.col("mu"))) + 1).cast("long"))).drop("__cuts")
    r = r.withColumns({"provisional": X.provisional("sigma_now", "opponents"), "conservative": F.col("mu") - 3 * F.col("sigma_now"), "win_rate": F.try_divide("wins", "games")})
    r = r.filter("recent > 0") if active else r
    r = windows.conditional_rank(r.withColumn("__down", -F.col("mu")), "__down", ["canonical_id"], F.col("provisional"))
    out = r.select("canonical_id", "mu", "sigma", "sigma_now", "conservative", "games", "opponents", "provisional", "win_rate", "last_match", "recent", "tier", "place")
    return out if limit is None else out.orderBy(F.desc("mu"), "canonical_id").limit(limit)


def meetings(players: DataFrame, matches: DataFrame, mode: str = DUEL) -> DataFrame:
    """A row for each match and pair a < b of its identities, with both sides' frags and damage; rows of one identity in a match are summed."""
    one = players.filter("canonical_id is not null").groupBy("match_id", "canonical_id").agg(
        *[F.sum(c).alias(n) for n, c in (("frags", "player_frags"), ("given", "player_damage_given"), ("taken", "player_damage_taken"))])
    a, b = (one.select("match_id", *[F.col(c).alias(f"{n}_{s}") for n, c in (("id", "canonical_id"), ("frags", "frags"), ("given", "given"), ("taken", "taken"))]) for s in "ab")
    m = matches.filter(F.col("match_mode") == mode).select("match_id", "match_map", "match_date")
    return a.join(b, "match_id").filter("id_a < id_b").join(m, "match_id")


def pair_record(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Matches, wins of both sides (nulls count as 0), draws, last match and damage ratios of ``meetings`` by ``keys``."""
    fa, fb = (F.coalesce(f"frags_{s}", F.lit(0)) for s in "ab")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("matches"), F.count_if(fa > fb).alias("wins_a"), F.count_if(fb > fa).alias("wins_b"), F.count_if(fa == fb).alias("draws"), F.max("match_date").alias("last_match"),
        *[F.try_divide(total(f"given_{s}"), total(f"taken_{s}")).alias(f"ddr_{s}") for s in "ab"])
    return g


def head_to_head(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """Record of every pair with the chance of a, blended with the record once the pair has met often enough. ``ratings``: canonical_id, mu, sigma; null
    chances where either has none."""
    pair = with_beliefs(pair_record(rows, ["id_a", "id_b"]), ratings, [])
    n = F.col("wins_a") + F.col("wins_b")
    return pair.withColumn("chance_a", X.head_to_head_blend(win_chance(), F.try_divide(F.col("wins_a"), n), n)).drop("mu_a", "mu_b", "sigma_a", "sigma_b")


def head_to_head_maps(rows: DataFrame, ratings: DataFrame, matches: DataFrame, mode: str = DUEL, pool: int = 20) -> DataFrame:
    """The record by map, on the ``pool`` most played maps of the mode (ties to the smaller name), with the chance of a where both are rated there.
    ``ratings``: canonical_id, match_map, mu, sigma."""
    played = matches.filter((F.col("match_mode") == mode) & F.col("match_map").isNotNull()).groupBy("match_map").agg(F.count("*").alias("n"))
    top = played.orderBy(F.desc("n"), "match_map").limit(pool).select("match_map")
    pair = pair_record(rows.join(F.broadcast(top), "match_map"), ["id_a", "id_b", "match_map"])
    return with_beliefs(pair, ratings, ["match_map"]).withColumn("chance_a", win_chance()).drop("mu_a", "mu_b", "sigma_a", "sigma_b")


def with_beliefs(pairs: DataFrame, ratings: DataFrame, keys: list[str]) -> DataFrame:
    for s in "ab":
        own = ratings.select(F.col("canonical_id").alias(f"id_{s}"), *keys, F.col("mu").alias(f"mu_{s}"), F.col("sigma").alias(f"sigma_{s}"))
        pairs = pairs.join(own, [f"id_{s}", *keys], "left")
    return pairs


def win_chance() -> Column:
    spread = F.sqrt(2 * F.lit(250.0) ** 2 + F.col("sigma_a") * F.col("sigma_a") + F.col("sigma_b") * F.col("sigma_b"))
    return X.normal_cdf((F.col("mu_a") - F.col("mu_b")) / spread)


def axis_ranges(players: DataFrame, matches: DataFrame, since: datetime, mode: str = DUEL, least: int = 5) -> DataFrame:
    """axis, low, high: smallest and largest average of the population on each axis of the skill profile, since a time."""
    m = matches.filter((F.col("match_mode") == mode) & (F.col("match_date") >= F.lit(since).cast("timestamp_ntz"))).select("match_id")
    each = players.filter("canonical_id is not null").join(m, "match_id").groupBy("canonical_id").agg(F.count("*").alias("n"), *[F.expr(e).cast("double").alias(a) for a, e in AXES.items()])
    return each.filter(F.col("n") >= least).unpivot(["canonical_id"], list(AXES), "axis", "value").groupBy("axis").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def cards(players: DataFrame, matches: DataFrame, mode: str = DUEL, least: int = 50) -> DataFrame:
    """canonical_id, matches, a rating of 0 to 99 for each of CARDS and their mean ``overall``: each value is shrunk to the population's mean by the
    number of matches and placed among the raw values. A row meets every other row of its match."""
    played = players.join(matches.filter(F.col("match_mode") == mode).select("match_id"), "match_id")
    other = played.select("match_id", F.col("player_name").alias("__name"), F.col("player_ra_taken").alias("opp_ra"), F.col("player_health100_taken").alias("opp_mh"))
    rows = played.filter("canonical_id is not null").join(other, "match_id").filter("player_name <> __name")
    sums = rows.groupBy("canonical_id").agg(F.count("*").alias("matches"), *[F.expr(e).cast("double").alias(c) for c, e in CARDS.items()]).filter(F.col("matches") >= least)
    long = sums.unpivot(["canonical_id", "matches"], list(CARDS), "card", "raw").filter("raw is not null")
    means = long.groupBy("card").agg(F.avg("raw").alias("mean"), F.count("*").alias("all"))
    # equal sums in another order must not part equal values
    h = long.join(F.broadcast(means), "card").withColumn("raw", F.round("raw", 9)).withColumn("shrunk", F.round(X.shrunk_to_mean("raw", "matches", "mean"), 9))  # a row for each of CARDS
    both = h.select("card", F.col("raw").alias("v"), F.lit(1).alias("own")).unionByName(h.select("card", F.col("shrunk").alias("v"), F.lit(0).alias("own")))
    below = ranks.counted_upto(both, ["card"], "v", weight=F.col("own")).select("card", F.col("v").alias("shrunk"), (F.col("upto") - F.col("k")).alias("below"))
    place = F.when(F.col("all") >= 2, F.least(F.lit(99), F.greatest(F.lit(0), F.bround(99.0 * F.col("below") / (F.col("all") - 1)).cast("int"))))
    rated = h.join(below, ["card", "shrunk"]).select("canonical_id", "card", place.alias("rating"))
    wide = rated.groupBy("canonical_id").pivot("card", list(CARDS)).agg(F.max("rating"))
    known = [F.col(c) for c in CARDS]
    mean = F.bround(F.aggregate(F.array_compact(F.array(*known)), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(F.array_compact(F.array(*known))), F.lit(0)))
    return sums.select("canonical_id", "matches").join(wide, "canonical_id").withColumn("overall", mean.cast("int"))
