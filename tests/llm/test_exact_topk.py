import math

import numpy as np

from arenaflow.llm import exact_topk as tk


def brute(rows, k=20, every=20, scale=64.0):
    use = [(i, [float(math.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in use:
        if q % every == 0:
            s = sorted((-int(sum(int(x) * int(y) for x, y in zip(a, b))), c) for c, b in use if c != q and len(a) == len(b))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 16)).round(2)
    base[100:400] = base[100]  # one very common vector: ties
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(700, None), (720, [None] * 16), (740, [float("nan")] * 16), (760, [1e300] * 15 + [float("inf")]), (780, [0.0] * 16), (800, []), (820, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, tk.top_products(df, block=7).collect())) == brute(rows)
    assert tk.top_products(df.filter("false")).count() == 0
    assert tk.top_products(df.filter("vec_id % 20 <> 0")).count() == 0


def test_values_beyond_doubles(spark):
    rows = [(i, [float(3**14 + i * 7919), float(i - 20)]) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, tk.top_products(df).collect())) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-9, 9, (5, 6)).astype(float), rng.integers(-9, 9, (50, 6)).astype(float)
    for depth in (1, 10, 50):
        lower, upper = tk.Lists(c).bounds(q, np.arange(50), depth)
        assert (lower <= q @ c.T).all() and (upper >= q @ c.T).all()
    assert (lower == upper).all()


def skewed(rng, n, m):
    """Few large components among many small ones, as in vectors of weights of words."""
    return np.where(rng.random((n, m)) < 0.02, rng.integers(1000, 9000, (n, m)), rng.integers(0, 3, (n, m))).astype(float)


def best(q, ids, c, k):
    return sorted((-int(s), int(i)) for s, i in zip(c @ q, ids))[:k]


def test_reads_a_part_of_skewed_lists_and_all_of_random_ones():
    rng = np.random.default_rng(2)
    ids, q_ids = np.arange(3000), np.arange(3000, 3008)
    for q, c, least, most in (
        (skewed(rng, 8, 24), skewed(rng, 3000, 24), 0, 0.6), (rng.integers(-64, 64, (8, 24)).astype(float), rng.integers(-64, 64, (3000, 24)).astype(float), 0.9, 1),
    ):
        read: dict = {}
        got = tk.top_of_lot(q_ids, q, ids, c, 20, read)
        for i, x in zip(q_ids, q):
            rows = got[got.query_id == i]
            assert [(-s, v) for s, v in zip(rows.score, rows.vec_id)] == best(x, ids, c, 20)
        share = np.mean(list(read.values())) / c.size
        assert least <= share <= most, share


def test_candidates_that_left_are_not_read_again(monkeypatch):
    """The product after the stop takes the rows of the candidates that are left, and of no other."""
    rng = np.random.default_rng(3)
    q, c = skewed(rng, 1, 24), skewed(rng, 3000, 24)
    asked = []

    class Spy(np.ndarray):
        def __getitem__(self, key):
            asked.append(key)
            return np.asarray(super().__getitem__(key))

    plain = tk.Lists.__init__

    def spied(self, c):
        plain(self, c)
        self.c = self.c.view(Spy)

    monkeypatch.setattr(tk.Lists, "__init__", spied)
    read: dict = {}
    tk.top_of_lot(np.array([-1]), q, np.arange(3000), c, 20, read)
    assert read[-1] < c.size and len(asked[-1]) <= tk.FEW * 20


def test_lots_keep_every_row(monkeypatch, spark):
    monkeypatch.setattr(tk, "LISTED", 64)
    rows = [(i, [float((i * 37) % 11), float(i % 7), 1.0][: 2 + i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, tk.top_products(df).collect())) == brute(rows)
