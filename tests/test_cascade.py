"""Deleting with everything that refers to it, and publishing all tables at once."""

import pytest

from arenaflow.operators import upserts

KEYS = {"league": "id", "team": "id", "game": "id", "report": "id"}
FOREIGN = [("team", "league", "league"), ("game", "home", "team"), ("game", "away", "team"), ("report", "game", "game"), ("team", "last_game", "game")]


def tables(spark):
    return {
        "league": spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string"),
        "team": spark.createDataFrame([(10, 1, None), (11, 2, 100), (12, 2, None), (13, None, None)], "id long, league long, last_game long"),
        "game": spark.createDataFrame([(100, 10, 12), (101, 12, 13), (102, 13, 13), (103, None, 11)], "id long, home long, away long"),
        "report": spark.createDataFrame([(1000, 100), (1001, 102), (1002, 103), (1003, None)], "id long, game long"),
    }


def ids(found):
    return {t: sorted(r[0] for r in df.collect()) for t, df in found.items()}


def test_three_levels_and_a_cycle(spark):
    """League 1 takes team 10, that game 100, that report 1000 and (back up) team 11, that game 103 and report 1002."""
    all_ = tables(spark)
    left, gone = upserts.cascade(all_, KEYS, FOREIGN, {"league": spark.createDataFrame([(1,), (None,)], "id long")})
    assert ids(gone) == {"league": [1], "team": [10, 11], "game": [100, 103], "report": [1000, 1002]}
    assert ids(left) == {"league": [2], "team": [12, 13], "game": [101, 102], "report": [1001, 1003]}
    assert all(left[t].columns == all_[t].columns for t in all_)
    again, nothing = upserts.cascade(left, KEYS, FOREIGN, {"league": spark.createDataFrame([(1,)], "id long")})
    assert ids(again) == ids(left) and set(nothing) == {"league"}


def test_nothing_doomed(spark):
    left, gone = upserts.cascade(tables(spark), KEYS, FOREIGN, {})
    assert gone == {} and ids(left) == ids(tables(spark))


def test_versions_swap_at_once(spark, tmp_path):
    root = str(tmp_path / "store")
    first = upserts.publish(tables(spark), root)
    assert ids(upserts.opened(spark, root)) == ids(tables(spark))
    left, _ = upserts.cascade(upserts.opened(spark, root), KEYS, FOREIGN, {"league": spark.createDataFrame([(1,)], "id long")})
    for _ in range(2):
        upserts.publish(left, root, "second")
        assert ids(upserts.opened(spark, root)) == ids(left)
    assert first != "second"
    with pytest.raises(Exception):
        upserts.publish({"league": left["league"].selectExpr("raise_error('lost') as id")}, root)
    assert ids(upserts.opened(spark, root)) == ids(left)
