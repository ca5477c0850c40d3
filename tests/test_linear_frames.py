"""Frames that look ahead stay linear in the rows of one key."""

import time

from pyspark.sql import functions as F

from arenaflow.operators import joins, windows


def test_many_events_of_one_user(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("user"), F.col("id").alias("at"), (F.col("id") % 50_000 == 49_999).alias("hit"))
    begin = time.time()
    nearest = joins.asof_next(rows, ["user"], "at", F.col("hit"), ["hit"], "at").agg(F.sum("next_at").alias("s"), F.count("next_at").alias("n")).first()
    assert (nearest.n, nearest.s) == (199_999, sum(49_999 * 50_000 + k * 50_000 * 50_000 for k in range(4)) - 49_999)
    soon = rows.withColumn("t", windows.time_to_next(rows, ["user"], F.col("at"), "at", F.col("hit"))).agg(F.sum("t").alias("s")).first()
    assert soon.s == sum((49_999 + k * 50_000) * 50_000 for k in range(4))
    assert time.time() - begin < 40


def test_ties_of_time_go_by_the_tie(spark):
    df = spark.createDataFrame([(1, 5, 1, False), (1, 5, 2, True), (1, 5, 3, True), (1, 6, 4, False), (1, None, 0, True)], "k int, at int, id int, hit boolean")
    got = {r.id: r.next_id for r in joins.asof_next(df, ["k"], "at", F.col("hit"), ["id"], "id").collect()}
    assert got == {0: 2, 1: 2, 2: 3, 3: None, 4: None}


def test_padding_leaves_own_rows_out(spark):
    own = spark.createDataFrame([(1, 10, 5.0), (2, 20, 9.0)], "k int, id int, v double")
    pool = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in ((20, 9.0), (10, 5.0), (30, 1.0))], "k int, id int, v double")
    got = sorted((r.k, r.place, r.id) for r in windows.padded_top(own, pool, "k", ["id"], [F.desc("v")], 3).collect())
    assert got == [(1, 1, 10), (1, 2, 20), (1, 3, 30), (2, 1, 20), (2, 2, 10), (2, 3, 30)]


def test_equal_times_come_by_their_tie(spark):
    rows = spark.createDataFrame([("u", 1, 1, False), ("u", 1, 2, True), ("u", 1, 3, False), ("u", 2, 4, True)], "user string, at long, id long, hit boolean")
    got = {r.id: r.t for r in rows.withColumn("t", windows.time_to_next(rows, ["user"], F.col("at"), "at", F.col("hit"), "id")).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}
    assert windows.rising_edges(rows, ["user"], "at", F.col("hit"), "id").first().edges == 2
    runs = windows.islands(rows, ["user"], "at", F.col("hit"), tie="id")
    assert {r.id: r.island for r in runs.collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
