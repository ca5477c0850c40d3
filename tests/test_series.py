"""Series that the clock settles: the stream against the table, with late, missing and repeated games."""

import random
from datetime import datetime, timedelta

from arenaflow.streaming import series as sr

T0 = datetime(2024, 1, 1)


def rows(n=40):
    rng = random.Random(1)
    out = []
    for s in range(n):
        at = T0 + timedelta(minutes=13 * s)
        for g in range(rng.randint(1, 6)):
            at += timedelta(minutes=rng.choice([1, 2, 3, 25]))
            out.append((s, s * 10 + g, at, rng.choice([True, False, None])))
    return sorted(out, key=lambda r: r[2])


def as_set(df):
    return sorted(str((r.series, r.first, r.last, r.wins_a, r.wins_b, r.games, r.winner, r.status)) for r in df.collect())


def test_settle():
    t = [T0 + timedelta(minutes=i) for i in range(5)]
    assert sr.settle([(t[0], 1, True), (t[2], 3, True), (t[1], 2, False), (t[3], 4, False)], 2)[2:] == (2, 1, 3, "a", "decided")
    assert sr.settle([(t[0], 1, True), (t[1], 2, None)], 2) == (t[0], t[1], 1, 0, 2, None, "expired")


def test_stream_equals_table(spark, tmp_path):
    """Batches out of order within the watermark, one delivered twice. The last games only move the clock on."""
    games = rows()
    rng = random.Random(2)
    batches = [games[i : i + 12] for i in range(0, len(games), 12)]
    end = [(10_000 + i, 0, games[-1][2] + timedelta(hours=5 * (i + 1)), True) for i in range(3)]
    (tmp_path / "in").mkdir()
    got = None
    src = spark.readStream.schema(sr.GAMES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = sr.settled_series(src, 2, 10, "30 minutes")
    for k, batch in enumerate([*batches, batches[-1], [end[0]], [end[1]], [end[2]]]):
        spark.createDataFrame(rng.sample(batch, len(batch)), sr.GAMES).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(sr.RESULT).parquet(str(tmp_path / "out")).filter("series < 10000")
    want = sr.series_results(spark.createDataFrame(games, sr.GAMES), 2, 10)
    assert as_set(got) == as_set(want) and want.filter("status = 'expired'").count() > 0 and want.filter("status = 'decided'").count() > 0


def test_table_of_nothing(spark):
    assert sr.series_results(spark.createDataFrame([], sr.GAMES)).count() == 0
