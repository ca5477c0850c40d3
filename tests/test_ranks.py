"""Ranks and order statistics of groups, cut into ranges or not, against sorted lists."""

import random

import pytest

from arenaflow.operators import ranks

SCHEMA = "g string, v double, id long"


def table(n=400, seed=1):
    rng = random.Random(seed)
    groups = ["hot"] * 6 + ["a", "b", None]
    return [(rng.choice(groups), rng.choice([None, float(rng.randint(0, 40)), round(rng.gauss(0, 50), 2)]), i) for i in range(n)]


@pytest.mark.parametrize("alone", [ranks.ALONE, 10])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks(spark, alone, descending):
    rows = table()
    got = {r.id: (r.place, r.of) for r in ranks.ranked(spark.createDataFrame(rows, SCHEMA), ["g"], "v", descending=descending, alone=alone).collect()}
    for g, v, i in rows:
        own = [x[1] for x in rows if x[0] == g]
        better = [x for x in own if x is not None and (v is None or (x > v if descending else x < v))]
        assert got[i] == (len(better) + 1, len(own))
    assert len(got) == len(rows)


@pytest.mark.parametrize("alone", [ranks.ALONE, 7])
def test_medians(spark, alone):
    rows = table(seed=2) + [("one", 4.0, -1), ("none", None, -2)] + [("same", 1.5, -3)] * 50
    got = {r.g: (r.n, r.upper, r.lower, r.middle) for r in ranks.medians(spark.createDataFrame(rows, SCHEMA), ["g"], "v", alone).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        if own:
            n = len(own)
            want[g] = (n, own[n // 2], own[(n - 1) // 2], own[(n - 1) // 2] + (own[n // 2] - own[(n - 1) // 2]) / 2)
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ranks.ranked(empty, ["g"], "v").count() == 0 and ranks.medians(empty, ["g"], "v").count() == 0


def test_one_large_group_stays_in_ranges(spark):
    """A million rows of one key: no range (the window's partition) holds more than a few times the allowed values, and the median is exact."""
    n = 1_000_000
    rows = spark.range(n).selectExpr("'hot' as g", "cast((id * 7919) % 1000003 as double) as v", "id")
    table = ranks.counted_upto(rows, ["g"], "v", 50_000)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "__range" in plan and "collect_list" not in plan
    own = sorted((i * 7919) % 1000003 for i in range(n))
    assert ranks.medians(rows, ["g"], "v", 50_000).first()[1:] == (n, float(own[n // 2]), float(own[n // 2 - 1]), (own[n // 2] + own[n // 2 - 1]) / 2)
