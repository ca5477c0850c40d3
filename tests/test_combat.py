"""Reactions against plain loops over hits, and the statistics made of them."""

import random

from pyspark.sql import functions as F

from arenaflow.operators import combat

HITS = "game long, id long, time long, attacker string, victim string, weapon string, damage int, is_self boolean, is_splash boolean"


def hits(seed, n=400):
    rng = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 10, 300, 1500])
        a, v = rng.choice("abc"), rng.choice("abc")
        out.append((rng.randint(1, 2), i, t, a, v, rng.choice(["rl", "lg"]), rng.choice([0, 20, 100]), a == v, rng.random() < 0.5))
    return out


def test_return_fire(spark):
    rows = hits(1)
    got = {r.id: r.reaction for r in combat.return_fire(spark.createDataFrame(rows, HITS), ["game"], "time", "id").collect()}
    want = {}
    for k, (game, i, t, a, v, *_) in enumerate(rows):
        if a != v:
            later = [h[2] - t for h in rows[k + 1 :] if h[0] == game and h[3] == v and h[4] == a]
            want[i] = later[0] if later and later[0] <= combat.LONGEST else None
    assert got == want and any(x is not None for x in want.values())


def sights(seed, n=80):
    rng = random.Random(seed)
    return [(i, rng.randint(1, 2), *rng.sample("abc", 2), s, s + rng.choice([0, 100, 1000, 9000, -5])) for i in range(n) for s in [rng.randint(0, 150_000)]]


SIGHTS = "id long, game long, looker string, seen string, start long, stop long"


def reaction(s, rows):
    _, game, looker, seen, start, stop = s
    first = [h[2] - start for h in rows if h[0] == game and h[3] == looker and h[4] == seen and h[6] > 0 and not h[7] and start <= h[2] <= stop + 250]
    return min(first) if first and min(first) <= 2000 else None


def test_first_hit_on_sight(spark):
    rows, seen = hits(2, 900), sights(3)
    real = spark.createDataFrame(rows, HITS).filter("damage > 0 and not is_self")
    got = {r.id: r.reaction for r in combat.sight_reactions(spark.createDataFrame(seen, SIGHTS), real, ["game"], "time").collect()}
    assert got == {s[0]: reaction(s, rows) for s in seen} and any(v is not None for v in got.values()) and None in got.values()


def test_statistics_of_a_series(spark):
    rows, seen = hits(4), sights(5)
    totals = [(1, "a", 900, 100, 50, 300, 100), (2, "a", 100, 0, 0, 0, 0), (1, "b", 10, 5, 1, 0, 0)]
    frags = [(1, "a", "b"), (1, "a", "c"), (2, None, "a"), (1, "c", None)]
    stats = combat.game_stats(
        spark.createDataFrame(totals, "game long, player string, given int, taken int, ewep int, rl_dmg int, lg_dmg int"), spark.createDataFrame(rows, HITS),
        spark.createDataFrame(seen, SIGHTS), spark.createDataFrame(frags, "game long, killer string, victim string"))
    got = {(r.game, r.player): r for r in stats.collect()}
    for game in (1, 2):
        for p in "abc":
            own = [h for h in rows if h[0] == game and h[3] == p and h[6] > 0 and not h[7] and h[5] == "rl"]
            looks = [s for s in seen if s[1] == game and s[2] == p]
            times = [x for x in (reaction(s, rows) for s in looks) if x is not None]
            r = got[game, p]
            assert (r.rockets_dmg, r.rockets_splash, r.rocket_dmg_sum) == (len(own), sum(h[8] for h in own), sum(h[6] for h in own))
            assert (r.insight_ms, r.react_n, r.react_sum_ms) == (sum(max(0, s[5] - s[4]) for s in looks), len(times), sum(times))
            assert (r.frags, r.deaths) == (sum(f[0] == game and f[1] == p for f in frags), sum(f[0] == game and f[2] == p for f in frags))
    known = spark.createDataFrame([(1, "A.", "anna"), (2, "a", "anna"), (1, "b", "bob"), (1, "B", "wrong"), (1, "c", None)], "game long, player_name string, canonical_id string")
    byid = combat.with_identity(stats, known)
    assert {(r.game, r.canonical_id) for r in byid.collect()} == {(1, "anna"), (2, "anna"), (1, "bob")}
    table = {r.canonical_id: r for r in combat.series_table(byid).collect()}
    a = table["anna"]
    assert (a.maps, a.damage, a.damage_taken, a.ewep_pct, a.rl_pref, a.frags_per_map) == (2, 500.0, 50.0, 5.0, 75.0, 1.0)
    assert combat.series_table(byid.filter("false")).count() == 0


def test_no_hits(spark):
    none = spark.createDataFrame([], HITS)
    assert combat.return_fire(none, ["game"], "time", "id").count() == 0
    assert combat.sight_reactions(spark.createDataFrame(sights(1), SIGHTS), none, ["game"], "time").filter(F.col("reaction").isNotNull()).count() == 0
