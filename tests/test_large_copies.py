"""Queries on small tables that hold what copies of large ones do: equal values whose sums came in another order, many rows of a match's keys."""

import random
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import pandas as pd

from arenaflow.plans import catalog


def table(folder, name, rows):
    pd.DataFrame(rows).to_parquet(folder / f"{name}.parquet")


def test_equal_means_keep_the_order_of_the_keys(spark, tmp_path):
    """Two customers with the same prices, the second's in the order that gives the larger float sum."""
    rng = random.Random(1)
    plain = lambda xs: reduce(lambda a, b: a + b, xs)  # sum() compensates
    while True:
        prices = [round(rng.random() * 1000, 2) for _ in range(12)]
        if plain(prices) < plain(prices[::-1]):
            break
    table(tmp_path, "orders", [{"o_custkey": k, "o_totalprice": x} for k, own in ((1, prices), (2, prices[::-1])) for x in own])
    got = {r.custkey: r.place for r in catalog.QUERIES["cond_rank_provisional"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 2}


def test_equal_means_are_equal_to_the_last_bit(spark, tmp_path):
    """Prices whose float sums in two orders part even after rounding to nine places: their customers keep the order of the keys and share a tier."""
    rng = random.Random(2)
    rounded = lambda xs: Decimal(repr(reduce(lambda a, b: a + b, xs) / len(xs))).quantize(Decimal("1e-9"), ROUND_HALF_UP)
    while True:
        prices = [round(100_000 + rng.random() * 200_000, 2) for _ in range(13)]
        if rounded(prices) < rounded(prices[::-1]):
            break
    low, high = [90_000.0] * 13, [310_000.0] * 13
    owners = [*enumerate([prices, prices[::-1], *[low] * 4, *[high] * 4], 1)]
    table(tmp_path, "orders", [{"o_custkey": k, "o_totalprice": x} for k, own in owners for x in own])
    got = {r.custkey: r.place for r in catalog.QUERIES["cond_rank_provisional"](spark, str(tmp_path)).collect()}
    assert (got[1], got[2]) == (5, 6)
    assert {r.tier: r.n for r in catalog.QUERIES["tier_hist"](spark, str(tmp_path)).collect()} == {1: 4, 3: 2, 4: 4}


def test_exact_mean_of_odd_values(spark):
    """Long fractions, large, infinite and missing values."""
    from arenaflow.operators import aggs

    groups = {"a": [1 / 3, 2 / 3, 1e15], "b": [1e15, 2 / 3, 1 / 3], "c": [1e300, 1.0], "d": [float("inf"), 1.0], "e": [None], "f": [None, 1e-9, 3e-9]}
    rows = spark.createDataFrame([(g, x) for g, own in groups.items() for x in own], "g string, x double")
    got = {r.g: r.m for r in rows.groupBy("g").agg(aggs.exact_mean("x").alias("m")).collect()}
    assert got == {"a": got["b"], "b": got["b"], "c": 5e299, "d": float("inf"), "e": None, "f": 2e-9} and abs(got["b"] - 1e15 / 3) < 1


def test_parts_grow_with_the_rows(spark):
    """Pairs are counted in so many parts that a part keeps its size: more rows, more parts, whatever the session's number."""
    from arenaflow.operators import joins

    few, many = spark.range(100), spark.range(750_000)
    assert joins.parts(few) == int(spark.conf.get("spark.sql.shuffle.partitions")) and joins.parts(many) == 15
    assert joins.by_match(many, "id").rdd.getNumPartitions() == 15


def test_wide_rows_are_shuffled_once_at_most(spark, tmp_path):
    """Lines are dealt by match before they become wide rows of players; a profile's rows go to their player once, not once for every cut."""
    from datetime import datetime

    table(tmp_path, "lineitem", [{"l_orderkey": i // 2, "l_suppkey": i % 7 + 1, "l_quantity": float(i % 50), "l_linenumber": i % 2 + 1, "l_extendedprice": 1.0} for i in range(80)])
    orders = pd.DataFrame([{"o_orderkey": i, "o_custkey": i % 3, "o_orderstatus": "FO"[i % 2], "o_orderpriority": "1-URGENT", "o_orderdate": datetime(2000, 1, 1 + i % 20)} for i in range(40)])
    orders.astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
    table(tmp_path, "customer", [{"c_custkey": i, "c_nationkey": i} for i in range(3)])
    table(tmp_path, "nation", [{"n_nationkey": i, "n_name": f"n{i}"} for i in range(3)])
    for name in ("profile_slices", "rankings", "rating_cards"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        deals = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert deals and not [d for d in deals if "l_suppkey" in d]
        if name == "profile_slices":
            assert sum("hashpartitioning(canonical_id" in d for d in deals) == 1 and "Expand" not in plan
