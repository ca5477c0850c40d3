"""Timed steps of challenges, matches resolved anew, previews."""

from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import schedule

NOW = "2024-03-06 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def test_auto_picks_and_agreement(spark):
    slots = [f"timestamp'2024-03-0{d} {h}:00:00'" for d, h in ((5, 18), (7, 18), (8, 20))]
    c = spark.sql(f"select 1L id, array({','.join(slots)}) proposed")
    members = spark.createDataFrame([(1, "x"), (1, "y")], "id long, member string")
    picks = spark.sql(f"select 1L id, 'x' member, array({','.join(slots)}) slots")
    # Thursday 18 h in UTC is 19 h in Berlin, Friday 20 h is 21 h
    free = spark.createDataFrame([("y", True, "Europe/Berlin", [4 * 24 + 19, 5 * 24 + 20])], "member string, opted boolean, zone string, hours array<int>")
    both = schedule.auto_picks(c, members, picks, free, now())
    assert {(r.member, len(r.slots)) for r in both.collect()} == {("x", 3), ("y", 1)}
    assert [str(r.slot) for r in schedule.agreed(members, both, now()).selectExpr("cast(slot as string) slot").collect()] == ["2024-03-07 18:00:00"]
    assert schedule.agreed(members, picks, now()).count() == 0
    assert schedule.auto_picks(c, members, picks, free.withColumn("opted", F.lit(False)), now()).count() == 1


def test_reminders_fire_once_in_their_windows(spark):
    rows = [(1, "scheduled", 70, 0, 9999), (2, "scheduled", 12, 0, 9999), (3, "scheduled", 71, 0, 9999), (4, "open", None, 4321, 10), (5, "open", None, 4321, -1), (6, "scheduled", 0, 0, 99), (7, "scheduled", 60, 0, 9999)]
    c = spark.createDataFrame(rows, "id int, status string, ahead int, age int, left int").select(
        "id", "status", *[F.timestamp_add("MINUTE", F.col(s) * k, now()).alias(n) for n, s, k in (("agreed_at", "ahead", 1), ("created_at", "age", -1), ("deadline", "left", 1))]
    )
    fired = spark.createDataFrame([(7, "hour")], "id int, kind string")
    assert sorted((r.id, r.kind) for r in schedule.due(c, fired, now()).collect()) == [(1, "hour"), (2, "soon"), (4, "nudge"), (5, "overdue")]


def test_expiry_and_reports(spark):
    c = spark.createDataFrame([(1, "open", "2024-03-06", 9, 9, True), (2, "open", "2024-03-06", 9, 8, True), (3, "open", "2024-03-06", 9, 8, None), (4, "open", "2024-03-07", 9, 8, True)], "id int, status string, d string, challenged_id int, proposed_by int, auto_forfeit boolean")
    got = schedule.expired(c.withColumn("deadline", F.col("d").cast("timestamp")), now())
    assert {(r.id, r.step) for r in got.collect()} == {(1, "cancel"), (2, "forfeit"), (3, "review")}
    r = spark.createDataFrame([(1, "played", 2, 2, True, NOW), (2, "open", 2, 2, True, NOW), (3, "open", 2, 2, False, NOW), (4, "open", 2, 1, False, NOW), (5, "open", 2, 1, False, "2024-03-01")], "report_id int, challenge_status string, wanted int, found int, decided boolean, t string")
    steps = schedule.report_steps(r.withColumn("created_at", F.col("t").cast("timestamp")), now())
    assert [x.step for x in steps.orderBy("report_id").collect()] == ["cancelled", "recorded", "review", "pending", "cancelled"]
    s = spark.sql("select timestamp'2024-03-06 11:50:00' last_played union all select timestamp'2024-03-06 11:50:01'")
    assert schedule.settled(s, now()).count() == 1


def test_refolding_and_recomputing(spark):
    m = spark.createDataFrame([(1, 1, 1, 1, None), (2, 2, 2, 1, None), (3, 1, 2, 2, 7), (4, 2, 1, 2, 7)], "id int, team_id int, to_rung int, at int, match_id int")
    assert {(r.team_id, r.rung) for r in schedule.without_match(m, [7]).collect()} == {(1, 1), (2, 2)}
    matches = spark.createDataFrame([(1, 10, 20, [(5, "dm", 9, 9), (6, "ae", 3, 4)])], "id int, team_a_id int, team_b_id int, maps array<struct<game_id:int,arena:string,a_frags:int,b_frags:int>>")
    players = spark.createDataFrame([(5, "x", 20), (5, "y", 5), (5, "z", 11), (6, "z", 8)], "game_id int, player string, frags int")
    rosters = spark.createDataFrame([(10, "x"), (10, "y"), (20, "z")], "team_id int, player string")
    maps = schedule.recomputed(matches, players, rosters).first().maps
    assert [(x.game_id, x.a_frags, x.b_frags) for x in maps] == [(5, 25, 11), (6, 3, 8)]


def test_previews(spark):
    c = spark.createDataFrame([(1, "p", "q"), (2, "p", "r"), (3, "q", "p")], "id int, a string, b string")
    games = spark.createDataFrame([("p", "q", 30, 10), ("q", "p", 20, 40), ("p", "q", None, 4)], "a string, b string, a_frags int, b_frags int")
    strength = spark.createDataFrame([("p", 60.0, 40.0)], "team string, efficiency double, frags double")
    got = {r.id: r for r in schedule.preview(c, games, strength).collect()}
    # two maps to none, 70 frags of 100: 0.5 + 2 / 6 * (0.5 * 1 + 0.5 * 0.7 - 0.5); 50 frags a map in 2 + 2 p (1 - p) maps are 123.64
    assert got[1].meetings == 2 and got[1].probability == 0.616667 and got[3].probability == 0.383333
    assert got[1].total == 123.5 and got[2].meetings == 0 and 0.5 < got[2].probability < 0.75
    assert [r.x for r in spark.createDataFrame([(0.5,), (0.9,), (0.2,)], "p double").select(X.market_line("p").alias("x")).collect()] == [-105, -605, 360]
