"""Ladders as event logs: standings, records, series of maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def standings(movements: DataFrame) -> DataFrame:
    """team_id, rung: the last movement of each team (by time, then id) tells its rung."""
    return movements.groupBy("team_id").agg(F.max_by("to_rung", F.struct("at", "id")).alias("rung"))


def ends_of(rungs: DataFrame, first: int, second: int) -> DataFrame:
    """``rungs`` beside the rungs of two teams, as f and s."""
    ends = rungs.agg(F.max(F.when(F.col("team_id") == first, F.col("rung"))).alias("f"), F.max(F.when(F.col("team_id") == second, F.col("rung"))).alias("s"))
    return rungs.join(F.broadcast(ends))  # one row


def swapped(rungs: DataFrame, first: int, second: int) -> DataFrame:
    """Two teams change places; nobody else moves."""
    new = F.when(F.col("team_id") == first, F.col("s")).when(F.col("team_id") == second, F.col("f")).otherwise(F.col("rung"))
    return ends_of(rungs, first, second).select("team_id", F.when(F.col("f").isNotNull() & F.col("s").isNotNull(), new).otherwise(F.col("rung")).alias("rung"))


def after_win(rungs: DataFrame, winner: int, loser: int) -> DataFrame:
    """A lower team that wins changes places with the loser, whatever lies between; else nothing moves."""
    new = F.when(F.col("team_id") == winner, F.col("s")).when(F.col("team_id") == loser, F.col("f"))
    return ends_of(rungs, winner, loser).select("team_id", F.when(F.col("f") > F.col("s"), F.coalesce(new, "rung")).otherwise(F.col("rung")).alias("rung"))


def after_forfeit(rungs: DataFrame, team: int, drop: int = 1) -> DataFrame:
    """A team that doesn't play changes places with the one ``drop`` rungs below, or with the last one where there is none there."""
    own = rungs.filter(F.col("team_id") == team).select(F.col("rung").alias("own"))
    wanted = F.col("own") + max(1, drop)
    below = rungs.join(F.broadcast(own)).filter(F.col("rung") > F.col("own"))  # one row
    target = below.agg(F.coalesce(F.max(F.when(F.col("rung") == wanted, F.col("rung"))), F.max("rung")).alias("target"), F.max("own").alias("own"))
    moved = rungs.join(F.broadcast(target))
    new = F.when(F.col("target").isNull(), F.col("rung")).when(F.col("team_id") == team, F.col("target")).when(F.col("rung") == F.col("target"), F.col("own")).otherwise(F.col("rung"))
    return moved.select("team_id", new.alias("rung"))


def placed_last(rungs: DataFrame, team: int) -> DataFrame:
    """A new team enters below all others; one that is there already stays."""
    last = rungs.agg((F.coalesce(F.max("rung"), F.lit(0)) + 1).alias("rung"), F.coalesce(F.bool_or(F.col("team_id") == team), F.lit(False)).alias("there"))
    return rungs.unionByName(last.filter("not there").select(F.lit(team).cast(rungs.schema["team_id"].dataType).alias("team_id"), F.col("rung").cast(rungs.schema["rung"].dataType).alias("rung")))


def same_set(left: DataFrame, right: DataFrame, column: str) -> bool:
    """Whether both hold the same different values."""
    a, b = (df.select(column).distinct() for df in (left, right))
    return not a.join(b, column, "left_anti").limit(1).count() and not b.join(a, column, "left_anti").limit(1).count()


def reordered(rungs: DataFrame, order: list[int]) -> DataFrame:
    """Rungs 1 to n in the given order, which must hold exactly the teams."""
    spark = rungs.sparkSession
    wanted = spark.createDataFrame([(t, i) for i, t in enumerate(order, 1)], "team_id long, rung long")
    if len(set(order)) != len(order) or not same_set(rungs, wanted, "team_id"):
        raise ValueError("the order must hold exactly the active teams")
    return wanted


def moves(before: DataFrame, after: DataFrame, reason: str) -> DataFrame:
    """team_id, from_rung, to_rung, reason of the teams whose rung changed, new ones among them: what the log of movements gets."""
    old = before.select("team_id", F.col("rung").alias("from_rung"))
    both = after.select("team_id", F.col("rung").alias("to_rung")).join(old, "team_id", "left")
    return both.filter(~F.col("from_rung").eqNullSafe(F.col("to_rung"))).select("team_id", "from_rung", "to_rung", F.lit(reason).alias("reason"))


def records(matches: DataFrame) -> DataFrame:
    """team_id, played, wins, last_win, last_loss: both sides of a match become rows."""
    sides = matches.filter("winner_id is not null").select("winner_id", "played_at", F.explode(F.array("team_a_id", "team_b_id")).alias("team_id"))
    won = F.col("team_id") == F.col("winner_id")
    return sides.groupBy("team_id").agg(F.count("*").alias("played"), F.count_if(won).alias("wins"), F.max(F.when(won, F.col("played_at"))).alias("last_win"), F.max(F.when(~won, F.col("played_at"))).alias("last_loss"))


def series_games(matches: DataFrame, target: int = 2) -> DataFrame:
    """Games of each match up to the clinch; a game without frags or tied counts for nobody."""
    g = matches.select("id", F.posexplode("maps").alias("game", "m")).select("id", "game", "m.*")
    before = W.partitionBy("id").orderBy("game").rowsBetween(W.unboundedPreceding, -1)
    a = F.coalesce(F.count_if(F.col("a_frags") > F.col("b_frags")).over(before), F.lit(0))
    b = F.coalesce(F.count_if(F.col("b_frags") > F.col("a_frags")).over(before), F.lit(0))
    return g.withColumn("a", a).withColumn("b", b).filter((F.col("a") < target) & (F.col("b") < target)).drop("a", "b")


def series_result(matches: DataFrame, target: int = 2) -> DataFrame:
    """id, a_maps, b_maps, winner (a, b or null while open)."""
    g = series_games(matches, target).groupBy("id").agg(F.count_if(F.col("a_frags") > F.col("b_frags")).alias("a_maps"), F.count_if(F.col("b_frags") > F.col("a_frags")).alias("b_maps"))
    return g.withColumn("winner", F.when(F.col("a_maps") >= target, "a").when(F.col("b_maps") >= target, "b"))


def common_slot(picks: DataFrame) -> DataFrame:
    """id, slot: the earliest slot that every member of a challenge picked (null if none)."""
    p = picks.select("id", "member", F.explode("slots").alias("slot")).distinct()
    members = picks.groupBy("id").agg(F.countDistinct("member").alias("n"))
    full = p.groupBy("id", "slot").agg(F.count("*").alias("k")).join(members, "id").filter("k = n").groupBy("id").agg(F.min("slot").alias("slot"))
    return members.select("id").join(full, "id", "left")


def map_stats(matches: DataFrame, target: int = 2) -> DataFrame:
    """map, played, first_pick, decider and avg_total (frags of both sides) with the shares of the first three. ``matches``: id, maps (map, a_frags, b_frags). The decider
    is the map that clinches, not the last one played; games without a map's name count for nothing but keep their place."""
    g = matches.select("id", F.posexplode("maps").alias("game", "m")).select("id", "game", "m.map", "m.a_frags", "m.b_frags").filter("map is not null and map <> ''")
    upto = W.partitionBy("id").orderBy("game").rowsBetween(W.unboundedPreceding, 0)
    won = lambda x, y: F.count_if(F.col(x) > F.col(y)).over(upto)
    g = g.withColumn("a", won("a_frags", "b_frags")).withColumn("b", won("b_frags", "a_frags"))
    full = F.greatest("a", "b") >= target
    earlier = F.coalesce(F.max(full.cast("int")).over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("full", full).withColumn("earlier", earlier)
    one = g.groupBy("map").agg(
        F.count("*").alias("played"), F.count_if(F.col("game") == 0).alias("first_pick"), F.count_if(F.col("full") & (F.col("earlier") == 0)).alias("decider"), F.avg(F.col("a_frags") + F.col("b_frags")).alias("avg_total"))
    all_ = F.broadcast(one.agg(*[F.sum(c).alias(f"all_{c}") for c in ("played", "first_pick", "decider")]))  # one row
    share = lambda c: F.coalesce(F.round(100.0 * F.try_divide(c, f"all_{c}"), 1), F.lit(0.0)).alias(f"{c}_pct")
    return one.join(all_).select("map", "played", "first_pick", "decider", "avg_total", *[share(c) for c in ("played", "first_pick", "decider")])


def margins(matches: DataFrame, n: int = 5) -> DataFrame:
    """The n closest and the n widest games: kind, place, id, game, map, margin; ties to the smaller id and game."""
    g = matches.select("id", F.posexplode("maps").alias("game", "m")).select("id", "game", "m.map", F.abs(F.col("m.a_frags") - F.col("m.b_frags")).alias("margin")).filter("map is not null and margin is not null")
    kinds = {"closest": F.col("margin"), "widest": -F.col("margin")}
    best = None
    for kind, order in kinds.items():
        top = g.withColumn("__o", order).orderBy("__o", "id", "game").limit(n).withColumn("kind", F.lit(kind))
        best = top if best is None else best.unionByName(top)
    place = F.row_number().over(W.partitionBy("kind").orderBy("__o", "id", "game"))  # 2 n rows
    return best.withColumn("place", place).select("kind", "place", "id", "game", "map", "margin")


#: Columns of the team and player tables: averages of a game, and shares of sums in percent.
AVERAGED = {
    "frags": "player_frags", "deaths": "player_deaths", "suicides": "player_suicides", "tk": "player_teamkills", "dmg_given": "player_damage_given", "dmg_taken": "player_damage_taken",
    "ya": "player_ya_taken", "ra": "player_ra_taken", "mh": "player_health100_taken", "quad": "player_quad_taken",
}
SHARED = {
    "eff": ("player_frags", "coalesce(player_frags, 0) + coalesce(player_deaths, 0)"), "sg": ("player_sg_hits", "player_sg_attacks"), "lg": ("player_lg_hits", "player_lg_attacks"), "rl": ("player_rl_directs", "player_rl_attacks"),
}


def per_game(rows: DataFrame, keys: list[str], game: str) -> DataFrame:
    """keys, maps, AVERAGED and SHARED of rows (a player in a game), sums of a game averaged over the games; nulls count as 0. A share of nothing is 0."""
    zero = lambda e: F.coalesce(F.expr(e), F.lit(0))
    sums = rows.groupBy(*keys, game).agg(*[F.sum(zero(e)).alias(n) for n, e in AVERAGED.items()], *[F.sum(zero(e)).alias(f"__{n}{i}") for n, pair in SHARED.items() for i, e in enumerate(pair)])
    return sums.groupBy(*keys).agg(
        F.count("*").alias("maps"), *[F.round(F.avg(n) + 1e-9, 1).alias(n) for n in AVERAGED],
        *[F.coalesce(F.round(100.0 * F.try_divide(F.sum(f"__{n}0"), F.sum(f"__{n}1")) + 1e-9, 1), F.lit(0.0)).alias(n) for n in SHARED])


def team_stats(teams: DataFrame, matches: DataFrame, rows: DataFrame) -> DataFrame:
    """``per_game`` of every team (team_id, members) over the games of its matches (team_a_id, team_b_id, game_ids) and its members; teams without one have maps 0.
    ``rows``: game_id, canonical_id and the counts."""
    sides = matches.select(F.explode(F.array("team_a_id", "team_b_id")).alias("team_id"), "game_ids").select("team_id", F.explode("game_ids").alias("game_id")).filter("game_id is not null").distinct()
    who = teams.select("team_id", F.explode(F.array_distinct("members")).alias("canonical_id"))
    own = rows.join(sides, "game_id").join(who, ["team_id", "canonical_id"])
    return teams.select("team_id").join(per_game(own, ["team_id"], "game_id"), "team_id", "left").withColumn("maps", F.coalesce("maps", F.lit(0)))


def player_stats(teams: DataFrame, matches: DataFrame, rows: DataFrame) -> DataFrame:
    """``per_game`` of every identity over all games of the ladder's matches, with the smallest team that lists it."""
    games = matches.select(F.explode("game_ids").alias("game_id")).filter("game_id is not null").distinct()
    who = teams.select(F.explode("members").alias("canonical_id"), "team_id").groupBy("canonical_id").agg(F.min("team_id").alias("team_id"))
    # every row of a player is a game of its own, as one that came back under another name has two
    own = rows.filter("canonical_id is not null").join(games, "game_id").withColumn("__row", F.monotonically_increasing_id())
    return per_game(own, ["canonical_id"], "__row").join(who, "canonical_id", "left")


def candidates(challenge: DataFrame, rows: DataFrame, before: str = "2 hours", after: str = "8 hours") -> DataFrame:
    """challenge, match_id, match_date, a_frags, b_frags, full: games around a rough time (``challenge``: challenge, at, a_members, b_members) in which both rosters
    play; ``full`` if nobody else does. ``rows``: match_id, match_date, canonical_id, player_frags."""
    c = challenge.select("challenge", "a_members", "b_members", (F.col("at") - F.expr(f"interval {before}")).alias("low"), (F.col("at") + F.expr(f"interval {after}")).alias("high"))
    who = c.select("challenge", "low", "high", F.explode(F.concat(
        F.transform("a_members", lambda m: F.struct(m.alias("canonical_id"), F.lit("a").alias("side"))), F.transform("b_members", lambda m: F.struct(m.alias("canonical_id"), F.lit("b").alias("side"))))).alias("m"))
    near = rows.join(who.select("challenge", "low", "high", "m.*"), "canonical_id").filter(F.col("match_date").between(F.col("low"), F.col("high")))
    sides = near.groupBy("challenge", "match_id", "match_date").agg(
        *[F.sum(F.when(F.col("side") == s, F.coalesce("player_frags", F.lit(0)))).alias(f"{s}_frags") for s in "ab"], F.countDistinct("canonical_id").alias("known"))
    both = sides.filter("a_frags is not null and b_frags is not null")
    all_ = rows.join(both.select("match_id").distinct(), "match_id", "left_semi").groupBy("match_id").agg(F.count("*").alias("all"))
    return both.join(all_, "match_id").select("challenge", "match_id", "match_date", "a_frags", "b_frags", (F.col("all") == F.col("known")).alias("full"))


def recorded(challenge_maps: DataFrame, games: DataFrame) -> DataFrame:
    """challenge, played_at: when the last of a result's games ended (null if none is known). ``challenge_maps``: challenge, game_ids."""
    ids = challenge_maps.select("challenge", F.explode_outer("game_ids").alias("game_id"))
    return ids.join(games.select("game_id", "match_date"), "game_id", "left").groupBy("challenge").agg(F.max("match_date").alias("played_at"))
