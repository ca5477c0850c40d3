"""Nearest centres through the tree of cells against all pairs."""

import math
import random

import pytest

from arenaflow.operators import nearest as nn


def places(rng, n, axes, spread):
    out = []
    for _ in range(n):
        c = [rng.choice([rng.gauss(0, spread), rng.gauss(1000, 0.01), float(rng.randint(0, 5))]) for _ in range(axes)]
        out.append(c)
    return out


@pytest.mark.parametrize("axes,leaf", [(1, 4), (2, 1), (2, 32), (3, 2)])
def test_equals_all_pairs(spark, axes, leaf):
    """Dense and empty regions, equal places, ties, points outside of all centres."""
    rng = random.Random(axes * 100 + leaf)
    names = ["x", "y", "z"][:axes]
    centres = [(*c, i) for i, c in enumerate(places(rng, 300, axes, 50))]
    centres += [(*centres[0][:-1], 999), (*centres[5][:-1], -7)]
    points = [(i, *p) for i, p in enumerate(places(rng, 200, axes, 500))] + [(1000 + i, *c[:-1]) for i, c in enumerate(centres[:20])]
    schema = ", ".join(f"{a} double" for a in names)
    got = {r.id: (r.label, r.distance) for r in nn.nearest(spark.createDataFrame(points, f"id long, {schema}"), spark.createDataFrame(centres, f"{schema}, label long"), "id", names, "label", leaf).collect()}
    for i, *p in points:
        d, label = min((sum((a - b) * (a - b) for a, b in zip(p, c[:-1])), c[-1]) for c in centres)
        assert got[i] == (label, pytest.approx(math.sqrt(d), abs=1e-12)), i
    assert len(got) == len(points)


def test_rows_without_a_place(spark):
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, float("inf"), 0.0), (1, 9.0, 9.0)], "id long, x double, y double")
    centres = spark.createDataFrame([(0.0, 0.0, 5), (None, 1.0, 6), (float("nan"), 1.0, 7), (0.0, 1.0, None)], "x double, y double, label long")
    got = sorted((r.id, r.label) for r in nn.nearest(points, centres, "id", ["x", "y"], "label").collect())
    assert got == [(1, 5), (1, 5), (2, None), (3, None), (4, None)]
    assert {r.label for r in nn.nearest(points, centres.filter("false"), "id", ["x", "y"], "label").collect()} == {None}
    assert nn.nearest(points.filter("false"), centres, "id", ["x", "y"], "label").count() == 0


def test_no_point_meets_all_centres(spark, monkeypatch):
    """20,000 centres, beyond the former limit: what meets at the leaves is a few dozen centres a point, not the product."""
    rng = random.Random(3)
    centres = spark.createDataFrame([(rng.random(), rng.random() ** 6, i) for i in range(20_000)], "x double, y double, label long")
    points = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(2000)], "id long, x double, y double")
    candidates = []
    keep = nn.written
    monkeypatch.setattr(nn, "written", lambda df, name: candidates.append(keep(df, name)) or candidates[-1] if name == "near" else keep(df, name))
    out = nn.nearest(points, centres, "id", ["x", "y"], "label")
    assert out.filter("label is not null").count() == 2000
    assert max(c.count() for c in candidates) < 40 * 2000


def test_equal_points_are_one_and_far_ones_reach_few_leaves(spark, monkeypatch):
    """What is written grows with the different points, also where they stand outside of the centres' box; every row gets its answer."""
    rng = random.Random(4)
    centres = [(900 + rng.random() * 1100, float(rng.randint(1, 50)), i) for i in range(5000)]
    asked = [(900 + rng.random() * 100_000, float(rng.randint(1, 50))) for _ in range(100)]
    points = [(k, *asked[k % 100]) for k in range(3000)]
    near = []
    keep = nn.written
    monkeypatch.setattr(nn, "written", lambda df, name: near.append(keep(df, name)) or near[-1] if name == "near" else keep(df, name))
    got = {r.id: (r.label, r.distance) for r in nn.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(centres, "x double, y double, label long"), "id", ["x", "y"], "label").collect()}
    want = [min(((p - x) * (p - x) + (q - y) * (q - y), i) for x, y, i in centres) for p, q in asked]
    assert all(got[k] == (want[k % 100][1], pytest.approx(math.sqrt(want[k % 100][0]), rel=1e-12)) for k in range(3000)) and len(got) == 3000
    assert sum(n.count() for n in near) <= 10 * 100
