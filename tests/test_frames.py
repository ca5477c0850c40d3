"""Frame operators against small fixtures and plain loops."""

import random

from pyspark.sql import functions as F

from arenaflow.operators import frames


def test_holdings_end_one_past_the_last_frame(spark):
    f = spark.createDataFrame([("m", "p", i, h) for i, h in enumerate([50, 120, 110, 100, 130, 140])], "match string, who string, at int, h int")
    got = {(r.start, r.stop) for r in frames.holdings(f, ["match"], "who", "at", F.col("h") > 100).collect()}
    assert got == {(1, 3), (4, 6)}


def test_grabs_use_the_short_and_the_long_return_time(spark):
    h = spark.createDataFrame([("m", "a", 0, 3), ("m", "b", 30, 60), ("m", "a", 79, 90), ("m", "b", 115, 120)], "match string, who string, start int, stop int")
    got = {(r.who, r.start): r.latency for r in frames.grabs(h, ["match"], "who", 1.0).collect()}
    assert got == {("b", 30): 5.0, ("a", 79): 0.0, ("b", 115): 5.0}


def plain_acquisitions(rows, near, most):
    out, seen, before = [], None, False
    for at, inside, off in rows:
        if off is None:
            seen, before = None, False
            continue
        if inside and not before and off > near:
            seen = at
        if seen is not None:
            if off < near:
                out.append((seen, at))
                seen = None
            elif at - seen > most:
                seen = None
        before = inside
    return sorted(out)


def test_acquisitions_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(k, i * 13, rng.random() < 0.4, rng.choice([None, *[rng.uniform(0, 40)] * 9])) for k in range(6) for i in range(400)]
    f = spark.createDataFrame(rows, "k int, at int, inside boolean, off double")
    got = frames.acquisitions(f, ["k"], "at", F.col("inside"), F.col("off"), 5.0, 100.0).collect()
    for k in range(6):
        want = plain_acquisitions([r[1:] for r in rows if r[0] == k], 5.0, 100.0)
        assert sorted((r.seen, r.acquired) for r in got if r.k == k) == want and want


def test_confirmed_keeps_what_a_hit_follows(spark):
    found = spark.createDataFrame([(1, 0, 100, 100), (1, 500, 900, 400)], "k int, seen int, acquired int, took int")
    hits = spark.createDataFrame([(1, 1050), (1, 1080), (2, 950)], "k int, at int")
    assert [(r.seen, r.hit_at) for r in frames.confirmed(found, hits, ["k"], "at").orderBy("seen").collect()] == [(0, 1050), (500, 1050)]


ITEMS = [("a", "armor", 0.0, 0.0), ("a", "weapon", 1000.0, 0.0), ("a", "armor", None, 5.0), ("b", "armor", 0.0, 0.0)]


def intent(spark, path, armor=0, dead_from=10**6, arena="a"):
    f = spark.createDataFrame([("m", arena, "p", i, float(x), 0.0, armor, i < dead_from) for i, x in enumerate(path)], "match string, arena string, player string, tick int, x double, y double, armor_value int, alive boolean")
    s = spark.createDataFrame([("m", "p", 0)], "match string, player string, tick int")
    r = frames.first_intent(f, s, spark.createDataFrame(ITEMS, "arena string, kind string, x double, y double")).collect()
    return (r[0].armor_first, r[0].weapon_first) if r else None


def test_first_intent(spark):
    assert intent(spark, range(500, 0, -20)) == (1, 0)  # touches armour
    assert intent(spark, range(500, 1001, 20)) == (0, 1)  # touches a weapon
    assert intent(spark, range(500, 100, -20)) == (1, 0)  # comes near enough
    assert intent(spark, range(500, 300, -20)) is None  # undecided
    assert intent(spark, range(500, 0, -20), armor=60) is None  # stacked
    assert intent(spark, range(500, 0, -20), dead_from=5) is None  # dies on the way
    assert intent(spark, range(500, 0, -20), arena="b") is None  # no weapons known
    assert intent(spark, [500] * 60 + [0]) is None  # after the traced frames


def test_fast_share_and_lift_offs(spark):
    f = spark.createDataFrame([(1, i, 500.0 if i < 10 else 100.0, 0.0, float(5 * i)) for i in range(40)], "k int, tick long, vx double, vy double, height double")
    hits = spark.createDataFrame([(1, 1, 26.0, 30), (1, 2, 260.0, 10), (1, 3, 13.0, 0), (1, 4, 99999.0, 50)], "k int, id int, time double, damage int")
    assert frames.fast_share(hits, f, ["k"], 13.0).first().fast_share == 75.0
    own = spark.createDataFrame([(1, 1, 13.0), (1, 2, 13.0 * 37)], "k int, id int, time double")
    assert frames.lift_offs(own, f, ["k"], 13.0).first().lift_offs == 1


def test_movement_card_couples_view_and_heading(spark):
    import math

    rows = [(1, i, 400 * math.cos(i * i / 90), 400 * math.sin(i * i / 90), math.degrees(i * i / 90) % 360, 30.0 if i % 4 else 0.0) for i in range(80)]
    r = frames.movement_card(spark.createDataFrame(rows, "k int, at int, vx double, vy double, yaw double, height double"), ["k"], "at").first()
    assert (r.speed_median, r.airborne_pct, r.coupling_1) == (400.0, 75.0, 1.0)
    few = frames.movement_card(spark.createDataFrame(rows[:5], "k int, at int, vx double, vy double, yaw double, height double"), ["k"], "at").first()
    assert few.coupling_1 is None


def test_airborne_shares_round_up_from_the_half(spark):
    rows = [(k, i, 1.0, 0.0, 0.0, 30.0 if i < k else 0.0) for k in (23, 41, 51) for i in range(80)]
    got = frames.movement_card(spark.createDataFrame(rows, "k int, at int, vx double, vy double, yaw double, height double"), ["k"], "at", lags=())
    assert {r.k: r.airborne_pct for r in got.collect()} == {23: 28.8, 41: 51.3, 51: 63.8}


def test_levers_by_priority(spark):
    m = spark.createDataFrame([(1, "x", 60.0, 40.0, 50.0), (1, "y", None, None, 9.0), (1, "z", None, None, None)], "k int, metric string, win double, loss double, overall double")
    marks = spark.createDataFrame([("x", 50.0, True), ("y", 10.0, False), ("z", 1.0, True)], "metric string, elite double, higher_better boolean")
    got = [(r.metric, r.priority, r.below, r.place) for r in frames.levers(m, marks, ["k"]).orderBy("place").collect()]
    assert got == [("x", 0.6, False, 1), ("y", 0.0, False, 2)]


def test_opening_score_falls_back_to_the_spawn(spark):
    marks = spark.createDataFrame([("a", "s", "e", 4.0, 1.0)] * 3 + [("a", "s", "f", 8.0, 0.5)] * 4, "arena string, own string, enemy string, seconds double, items double")
    runs = spark.createDataFrame([(1, "a", "s", "e", 16.0, 1.0, 1.0), (2, "a", "s", "f", 4.0, 0.5, 0.25), (3, "a", "new", "e", None, 0.0, 0.3), (4, "b", "s", "e", 1.0, 1.0, 1.0)], "id int, arena string, own string, enemy string, to_stack double, result double, item_tier double")
    got = {r.id: r.score for r in frames.opening_score(runs, marks).collect()}
    assert got == {1: 0.75, 2: 0.75, 3: 0.6}
