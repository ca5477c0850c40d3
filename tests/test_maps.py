"""Files about maps, players and demos; ladder tables and weekly grids on small cases."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arenaflow.operators import combat, ladder, schedule
from arenaflow.sources import maps


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('nick,geo,note\nann,"55.7, 13.2","a, ""b""\nc"\nbob,nowhere,\ncy,"1,2,3",x\ndi,,\ned,"-5.5,x",\n')
    got = {r.nick: (r.lat, r.lon, r.note) for r in maps.read_configs(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {"ann": (55.7, 13.2, 'a, "b"\nc'), "bob": (None, None, None), "cy": (None, None, "x"), "di": (None, None, None), "ed": (None, None, None)}


def test_entities_and_teleports(spark, tmp_path):
    (tmp_path / "e").mkdir()
    entities = [
        {"type": "spawn", "x": 1, "y": 2, "loc": "ra"}, {"type": "item", "kind": "rl", "x": 3, "y": 4, "z": 5}, {"type": "item", "x": 0, "y": 0},
        {"type": "teleportSrc", "x": 1, "y": 1, "z": 1, "target": "t1"}, {"type": "teleportSrc", "x": 2, "y": 2, "z": 2, "target": "none"}, {"type": "teleportSrc", "x": 3, "y": 3},
        {"type": "teleportDst", "x": 8, "y": 8, "z": 8, "targetName": "t1"}, {"type": "teleportDst", "x": 9, "y": 9, "z": 9, "targetName": "t1"}, {"type": "door"},
    ]
    (tmp_path / "e/dm4.json").write_text(json.dumps({"entities": entities}, indent=1))
    (tmp_path / "e/empty.json").write_text("{}")
    (tmp_path / "e/broken.json").write_text("{nope")
    docs = maps.read_entities(spark, str(tmp_path / "e"))
    got = {r["map"]: r for r in maps.layouts(docs).collect()}
    assert set(got) == {"dm4", "empty"} and got["empty"].spawns == [] == got["empty"].teles
    r = got["dm4"]
    assert [(s.x, s.y, s.z, s.loc) for s in r.spawns] == [(1, 2, 0, "ra")] and [i.kind for i in r["items"]] == ["rl"]
    assert [(t["from"].x, t["to"] and t["to"].x, t.target) for t in r.teles] == [(1, 9, "t1"), (2, None, "none"), (3, None, None)]
    assert {(r.source.x, r.exit and r.exit.x) for r in maps.teleports(docs).collect()} == {(1, 9), (2, None), (3, None)}


def test_geometry_and_aliases(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/dm4.json").write_text(json.dumps({"vertices": [[0, 0, 0], [1, 0, 0.5]], "faces": [[0, 1]]}))
    (tmp_path / "g/bad.json").write_text("[")
    got = {r["map"]: r.geometry for r in maps.read_geometry(spark, str(tmp_path / "g")).collect()}
    assert got["dm4"].vertices[1] == [1, 0, 0.5] and got["dm4"].faces == [[0, 1]] and got["bad"] is None
    (tmp_path / "a.json").write_text('{"canonical_id": "bob", "variants": ["Rob"]}\n{"display": "x"}\n')
    assert [(r.canonical_id, r.variants) for r in maps.read_aliases(spark, str(tmp_path / "a.json")).collect()] == [("bob", ["Rob"])]


def test_features_of_a_demo(spark, tmp_path):
    doc = {
        "game_id": 7, "damage": {"byPlayer": {"ann": {"given": 100, "byWeapon": {"rl": 80}}}, "events": [{"time": 500, "attacker": "ann", "victim": "bob", "weapon": "rl", "damage": 80, "isSelf": False, "isSplash": True}]},
        "los": {"players": [{"name": "ann", "los": [{"o": 1, "iv": [{"s": 100, "e": 400}]}, {"o": 5, "iv": [{"s": 0, "e": 50}]}]}, {"name": "bob", "los": []}]},
        "frags": [{"time": 500, "killer": "ann", "victim": "bob"}],
    }
    (tmp_path / "f.json").write_text(json.dumps(doc) + "\n{broken\n" + json.dumps({"game_id": 8}) + "\n")
    docs = maps.read_features(spark, str(tmp_path / "f.json"))
    assert [r.game_id for r in docs.collect()] == [7, None, 8]
    stats = {r.player: r for r in combat.game_stats(**maps.feature_tables(docs)).collect()}
    a = stats["ann"]
    assert (a.given, a.rl_dmg, a.rockets_dmg, a.rockets_splash, a.insight_ms, a.react_n, a.react_sum_ms, a.frags) == (100, 80, 1, 1, 350, 1, 400, 1) and stats["bob"].deaths == 1


def test_player_map_and_peaks(spark):
    c = spark.createDataFrame([("a", "ann", "SE", None, None), ("b", "bob", None, 1.0, 2.0), ("c", "cy", None, None, None)], "canonical_id string, nick string, nationality string, lat double, lon double")
    who = spark.createDataFrame([("a", "Ann!")], "canonical_id string, display_name string")
    assert {(r.nick, r.display) for r in maps.player_map(c, who).collect()} == {("ann", "Ann!"), ("bob", "bob")}
    f = spark.createDataFrame([(1, 0, 5.0), (1, 1, 9.0), (1, 2, 9.0), (2, 0, None), (2, 1, -1.0)], "k long, at long, vz double")
    assert {tuple(r) for r in maps.peak(f, ["k"], "at", "vz").collect()} == {(1, 1, 9.0), (2, 1, -1.0)}


def rungs(df):
    return {r.team_id: r.rung for r in df.collect()}


def test_moves_of_a_ladder(spark):
    r = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (9, None)], "team_id long, rung long")
    assert rungs(ladder.after_win(r, 4, 2)) == {1: 1, 2: 4, 3: 3, 4: 2, 9: None}
    assert rungs(ladder.after_win(r, 1, 3)) == rungs(r) and rungs(ladder.swapped(r, 1, 77)) == rungs(r)
    assert rungs(ladder.after_forfeit(r, 1, 2)) == {1: 3, 2: 2, 3: 1, 4: 4, 9: None}
    assert rungs(ladder.after_forfeit(r, 3, 2)) == {1: 1, 2: 2, 3: 4, 4: 3, 9: None}
    assert rungs(ladder.after_forfeit(r, 4, 1)) == rungs(r)
    assert rungs(ladder.placed_last(r, 5))[5] == 5 and ladder.placed_last(r, 2).count() == 5 and rungs(ladder.placed_last(r.filter("false"), 5)) == {5: 1}
    four = r.filter("rung is not null")
    assert rungs(ladder.reordered(four, [3, 1, 2, 4])) == {3: 1, 1: 2, 2: 3, 4: 4}
    for wrong in ([1, 2, 3], [1, 2, 3, 4, 5], [1, 2, 3, 3]):
        with pytest.raises(ValueError):
            ladder.reordered(four, wrong)
    assert {tuple(m) for m in ladder.moves(four, ladder.placed_last(ladder.swapped(four, 1, 2), 5), "win").collect()} == {(1, 1, 2, "win"), (2, 2, 1, "win"), (5, None, 5, "win")}


MAPS = "id long, maps array<struct<map:string,a_frags:int,b_frags:int>>"


def test_map_statistics(spark):
    """The decider clinches: what is played after it counts as played only; ties, missing frags and nameless games don't win."""
    m = spark.createDataFrame([
        (1, [("dm4", 10, 5), ("dm2", 1, 9), ("dm6", 7, 3), ("dm4", 50, 0)]), (2, [("dm2", 5, 5), ("dm4", None, 3), (None, 9, 1), ("dm2", 4, 1), ("dm2", 8, 2)]), (3, []), (4, None)], MAPS)
    got = {r["map"]: r for r in ladder.map_stats(m).collect()}
    assert {k: (r.played, r.first_pick, r.decider) for k, r in got.items()} == {"dm4": (3, 1, 0), "dm2": (4, 1, 1), "dm6": (1, 0, 1)}
    assert got["dm2"].avg_total == (10 + 10 + 5 + 10) / 4 and got["dm4"].avg_total == (15 + 50) / 2 and got["dm4"].played_pct == 37.5 and got["dm2"].decider_pct == 50.0
    assert [(r.kind, r.place, r["map"], r.margin) for r in ladder.margins(m, 2).orderBy("kind", "place").collect()] == [("closest", 1, "dm2", 0), ("closest", 2, "dm2", 3), ("widest", 1, "dm4", 50), ("widest", 2, "dm2", 8)]


def rows(spark):
    cols = sorted({w for e in [*ladder.AVERAGED.values(), *(x for p in ladder.SHARED.values() for x in p)] for w in re.findall(r"player_\w+", e)})
    data = [(1, "A", 10, 10), (1, "B", 6, None), (1, "Z", 5, 5), (2, "A", 4, 2), (3, "A", 99, 1), (2, None, 1, 1)]
    df = spark.createDataFrame(data, "game_id long, canonical_id string, player_frags int, player_deaths int")
    return df.select("*", *[F.lit(2).alias(c) for c in cols if c not in ("player_frags", "player_deaths")])


def test_team_and_player_statistics(spark):
    teams = spark.createDataFrame([(1, ["A", "B", "A"]), (2, ["Z"]), (3, ["Q"])], "team_id long, members array<string>")
    matches = spark.createDataFrame([(1, 2, [1, 2, None]), (2, 3, [])], "team_a_id long, team_b_id long, game_ids array<long>")
    got = {r.team_id: r for r in ladder.team_stats(teams, matches, rows(spark)).collect()}
    assert (got[1].maps, got[1].frags, got[1].deaths, got[1].eff, got[1].suicides) == (2, 10.0, 6.0, 62.5, 3.0) and (got[2].maps, got[2].frags) == (1, 5.0) and (got[3].maps, got[3].eff) == (0, None)
    players = {r.canonical_id: r for r in ladder.player_stats(teams, matches, rows(spark)).collect()}
    assert (players["A"].maps, players["A"].frags, players["A"].team_id, players["A"].lg) == (2, 7.0, 1, 100.0) and set(players) == {"A", "B", "Z"}


def test_candidates_for_a_result(spark):
    t = datetime(2024, 1, 1, 20)
    c = spark.createDataFrame([(1, t, ["A", "B"], ["X"])], "challenge long, at timestamp_ntz, a_members array<string>, b_members array<string>")
    data = [(1, 19, "A", 5), (1, 19, "X", 3), (2, 21, "A", 1), (2, 21, "X", 2), (2, 21, "stranger", 0), (3, 17, "A", 1), (3, 17, "X", 1), (4, 20, "A", 1), (4, 20, "B", 1)]
    r = spark.createDataFrame([(m, datetime(2024, 1, 1, h), who, f) for m, h, who, f in data], "match_id long, match_date timestamp_ntz, canonical_id string, player_frags int")
    assert {(x.match_id, x.a_frags, x.b_frags, x.full) for x in ladder.candidates(c, r).collect()} == {(1, 5, 3, True), (2, 1, 2, False)}
    games = spark.createDataFrame([(7, t), (8, datetime(2024, 1, 2))], "game_id long, match_date timestamp_ntz")
    asked = spark.createDataFrame([(1, [7, 8, 99]), (2, []), (3, None)], "challenge long, game_ids array<long>")
    assert {tuple(x) for x in ladder.recorded(asked, games).collect()} == {(1, datetime(2024, 1, 2)), (2, None), (3, None)}


def test_weekly_grids(spark):
    df = spark.createDataFrame([(1, {"mon": [20, 3, 20, 27, -1, 26], "tue": [], "xyz": [5], "sun": None}), (2, {"tue": []}), (3, None)], "id long, grid map<string,array<int>>")
    assert {r.id: r.g for r in df.select("id", schedule.clean_availability("grid").alias("g")).collect()} == {1: {"mon": [3, 20, 26]}, 2: None, 3: None}
    at = [(datetime(2024, 1, 1, 20), "UTC", True), (datetime(2024, 1, 2, 2, 30), "UTC", True), (datetime(2024, 1, 2, 3), "UTC", False), (datetime(2024, 1, 2, 1), "America/New_York", True), (datetime(2024, 1, 2, 1), None, True), (None, "UTC", False)]
    one = spark.createDataFrame([(t, z, {"mon": [20, 26]}) for t, z, _ in at], "at timestamp_ntz, zone string, grid map<string,array<int>>")
    assert [r.x for r in one.select(schedule.in_availability("at", "zone", "grid").alias("x")).collect()] == [x for *_, x in at]
