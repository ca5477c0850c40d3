"""Whitening against numpy on small tables and the given one."""

import math

import numpy as np
import pytest

from arenaflow.llm import whitening as wh


def plain(rows):
    """id -> (n, deviation, whitened up to sign, explained) of (id, vector) rows of one length."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:8]
    keep = [k for k in order if e[k] > 1e-15 * e.max()]
    out = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return n, out, centred @ v[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum()


def check(got, rows):
    n, deviations, whitened, explained = plain(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    k = len(explained)
    assert sorted(by_id) == sorted(i for i, _ in rows) and all(sorted(r.component for r in rs) == list(range(1, k + 1)) for rs in by_id.values())
    found = np.array([[r.whitened for r in sorted(by_id[i], key=lambda r: r.component)] for i, _ in rows])
    signs = np.sign((found * whitened).sum(axis=0))
    assert np.allclose(found, whitened * signs, atol=1e-7)
    for (i, _), d in zip(rows, deviations):
        for r in by_id[i]:
            assert (r.n, r.deviation) == (n, d) and abs(r.explained / explained[r.component - 1] - 1) < 1e-8 and r.identity_error < 1e-6


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(wh.whitened_entries(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("dims,rows", [(3, 40), (20, 200)])
def test_skewed_rows(spark, dims, rows):
    rng = np.random.default_rng(dims)
    data = [(i, (rng.normal(size=dims) * np.arange(1, dims + 1) + 3).tolist()) for i in range(rows)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, n int, whitened string")
    check(wh.whitened_entries(df).collect(), data)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, math.nan, 2.0, 3.0]), (103, [math.inf, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>")
    check(wh.whitened_entries(df).collect(), data)


def test_repeated_rows_and_null_ids(spark):
    data = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 5.0]), (3, [4.0, 2.0])]
    got = wh.whitened_entries(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (3, 1), (3, 2)]
    assert {r.n for r in got} == {4}


def test_lower_rank_gives_fewer_components(spark):
    data = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    got = wh.whitened_entries(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 for r in got)


def test_nothing_to_fit(spark):
    schema = "vec_id long, embedding array<double>"
    for data in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        out = wh.whitened_entries(spark.createDataFrame(data, schema))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_long_arithmetic(spark):
    """Extremes whose squares no long holds are summed in decimals; what a long can't hold at the end is null."""
    data = [(1, [3e9, 0.0]), (2, [-3e9, 1.0]), (3, [0.0, 0.0])]
    n, sums = 3, [0, 0]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in data]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    got = {r.vec_id: r.deviation for r in wh.whitened_entries(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (d if d < 2**63 else None) for (i, _), d in zip(data, want)}
