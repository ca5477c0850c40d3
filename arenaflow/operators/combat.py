"""Who reacts to whom: return fire, first hits on sight, and the per-game statistics made of them.

Hits have ``keys`` (the game), a time, an order within equal times, attacker and victim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import names as N
from arenaflow.operators.joins import interval_join, resolve_by_priority

#: How long after it ends a sight still counts (ms), and the longest reaction (ms).
GRACE, LONGEST = 250, 2000
#: Sums of a player's game, all 0 where nothing happened.
SUMS = ["given", "taken", "ewep", "rl_dmg", "lg_dmg", "rockets_dmg", "rockets_direct", "rockets_splash", "rocket_dmg_sum", "insight_ms", "react_sum_ms", "react_n", "frags", "deaths"]


def return_fire(hits: DataFrame, keys: list[str], at: str, tie: str, within: float = LONGEST) -> DataFrame:
    """``hits`` on others with reaction: the time until the victim next hits the attacker, null where that takes longer than ``within`` or never
    comes. One sort of each pair's hits, read backwards; no join."""
    rows = hits.filter("attacker <> victim")
    low = F.least("attacker", "victim")
    w = W.partitionBy(*keys, "__low", "__high").orderBy(F.desc(at), F.desc(tie)).rowsBetween(W.unboundedPreceding, -1)
    of = lambda side: F.last(F.when(F.col("attacker") == F.col(side), F.col(at)), ignorenulls=True).over(w)
    rows = rows.withColumn("__low", low).withColumn("__high", F.greatest("attacker", "victim")).withColumn("__by_low", of("__low")).withColumn("__by_high", of("__high"))
    wait = F.when(F.col("attacker") == F.col("__low"), F.col("__by_high")).otherwise(F.col("__by_low")) - F.col(at)
    return rows.withColumn("reaction", F.when(wait <= within, wait)).drop("__low", "__high", "__by_low", "__by_high")


def sight_reactions(sights: DataFrame, hits: DataFrame, keys: list[str], at: str, grace: float = GRACE, longest: float = LONGEST) -> DataFrame:
    """``sights`` (keys, looker, seen, start, stop and an id of its own) with reaction: the time from the start to the looker's first hit on the seen
    one, if it comes before the sight has been over for ``grace`` and within ``longest``. Only that stretch of a sight is joined, so
    a sight touches two buckets at most."""
    stretch = sights.withColumn("__until", F.least(F.col("stop") + grace, F.col("start") + longest))
    fire = hits.select(*keys, F.col("attacker").alias("looker"), F.col("victim").alias("seen"), F.col(at).alias("__at"))
    met = interval_join(stretch, fire, [*keys, "looker", "seen"], "start", "__until", "__at", longest)
    first = met.groupBy("id").agg(F.min(F.col("__at") - F.col("start")).alias("reaction"))
    return sights.join(first, "id", "left")


def game_stats(totals: DataFrame, damage: DataFrame, sights: DataFrame, frags: DataFrame) -> DataFrame:
    """game, player and SUMS. ``totals``: game, player, given, taken, ewep, rl_dmg, lg_dmg; ``damage``: game, time, attacker, victim, weapon, damage,
    is_self, is_splash; ``sights``: id, game, looker, seen, start, stop; ``frags``: game, killer, victim. Own and harmless hits count for nothing."""
    real = damage.filter("damage > 0 and not coalesce(is_self, false)")
    rockets = real.filter("weapon = 'rl'").groupBy("game", F.col("attacker").alias("player")).agg(
        F.count("*").alias("rockets_dmg"), F.count_if(~F.coalesce("is_splash", F.lit(False))).alias("rockets_direct"), F.count_if("is_splash").alias("rockets_splash"), F.sum("damage").alias("rocket_dmg_sum"))
    seen = sight_reactions(sights, real, ["game"], "time").groupBy("game", F.col("looker").alias("player")).agg(
        F.sum(F.greatest(F.col("stop") - F.col("start"), F.lit(0))).alias("insight_ms"), F.sum("reaction").alias("react_sum_ms"), F.count("reaction").alias("react_n"))
    killed = frags.filter("killer is not null").groupBy("game", F.col("killer").alias("player")).agg(F.count("*").alias("frags"))
    died = frags.filter("victim is not null").groupBy("game", F.col("victim").alias("player")).agg(F.count("*").alias("deaths"))
    parts = [totals, rockets, seen, killed, died]
    long = None
    for part in parts:
        wide = part.select("game", "player", *[F.col(c).cast("double").alias(c) if c in part.columns else F.lit(None).cast("double").alias(c) for c in SUMS])
        long = wide if long is None else long.unionByName(wide)
    return long.filter("player is not null").groupBy("game", "player").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS])


def with_identity(stats: DataFrame, known: DataFrame) -> DataFrame:
    """game, canonical_id and SUMS: players by their exact name in the game, else by the normal form of it; others go. ``known``: game, player_name,
    canonical_id."""
    named = stats.withColumn("__id", F.struct("game", "player"))
    key = lambda game, name: F.struct(F.col(game), name)
    kinds = [(key("game", F.col("player")), key("known_game", F.col("player_name"))), (key("game", N.normalised("player")), key("known_game", N.normalised("player_name")))]
    rows = known.filter("canonical_id is not null").select(F.col("game").alias("known_game"), "player_name", "canonical_id")
    found = resolve_by_priority(named, rows, kinds, "__id", "canonical_id").filter("canonical_id is not null")
    return found.groupBy("game", "canonical_id").agg(*[F.sum(c).alias(c) for c in SUMS])


def series_table(stats: DataFrame) -> DataFrame:
    """A row for each identity over the games of ``stats``: sums a map, shares in percent, mean rocket and mean reaction, best damage first by place."""
    s = stats.groupBy("canonical_id").agg(F.count("*").alias("maps"), *[F.sum(c).alias(c) for c in SUMS])
    per_map = lambda c, d=1: F.round(c / F.col("maps"), d)
    pct = lambda a, b: F.coalesce(F.round(100 * F.try_divide(a, b)), F.lit(0.0))
    both = F.col("rl_dmg") + F.col("lg_dmg")
    out: dict[str, Column] = {
        "damage": per_map(F.col("given"), 0), "damage_taken": per_map(F.col("taken"), 0), "ewep_pct": pct(F.col("ewep"), F.col("given")), "rl_pref": pct(F.col("rl_dmg"), both),
        "avg_rocket": F.coalesce(F.round(F.try_divide("rocket_dmg_sum", "rockets_dmg")), F.lit(0.0)), "react_ms": F.round(F.try_divide("react_sum_ms", "react_n")),
        "frag_diff": per_map(F.col("frags") - F.col("deaths")),
    }
    out |= {f"{c}_per_map": per_map(F.col(c)) for c in ("rockets_dmg", "rockets_direct", "rockets_splash", "frags", "deaths")}
    return s.select("canonical_id", "maps", *[c.alias(n) for n, c in out.items()])
