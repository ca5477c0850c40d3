import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from arenaflow.functions import names as N
from arenaflow.operators import joins, windows
from arenaflow.sources import outputs
from arenaflow.streaming import upkeep

T0 = datetime(2024, 1, 1)


def test_unescaped(spark):
    for raw, want in (("cr\\5onus", "cronus"), ("\\1[x\\1]", "x"), ("a\\27b", "a7b"), ("a\\2zb", "ab"), ("\\\\5x", "\\5x"), ("\\5\\\\y", "\\y"), ("q\\x7fz", "qz"), ("", "")):
        assert spark.range(1).select(N.unescaped(F.lit(raw)).alias("x")).first().x == want, raw


def test_zip_and_runs(spark):
    a = spark.createDataFrame([("k", i, f"a{i}") for i in range(3)] + [("m", 1, "z")], "k string, o int, a string")
    b = spark.createDataFrame([("k", 9 - i, f"b{i}") for i in range(2)], "k string, o int, b string")
    assert sorted(map(tuple, joins.zipped(a, b, ["k"], ["o"]).select("place", "a", "b").collect())) == [(1, "a0", "b1"), (2, "a1", "b0")]
    r = spark.createDataFrame([("k", 1, False), ("k", 2, None), ("k", 3, True), ("k", 4, False), ("m", 1, True)], "k string, o int, died boolean")
    assert [tuple(x) for x in windows.opening_runs(r, ["k"], ["o"], "died", [F.max("o").alias("last")]).collect()] == [("k", 2, 2)]


def test_documents_are_written_where_they_change(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 2, None) for i in range(20)], "id long, n long, note string")
    docs = outputs.documents(rows, "id", ["n", "note"])
    path = str(tmp_path / "out")
    outputs.write_documents(docs, "id", path, 4)
    index = spark.read.parquet(f"{path}/index")
    assert outputs.to_write(docs, index, "id").count() == 0
    new = outputs.documents(rows.withColumn("n", F.when(F.col("id") == 7, 0).otherwise(F.col("n"))).union(spark.createDataFrame([(99, 1, "x")], rows.schema)), "id", ["n", "note"])
    assert sorted(r.id for r in outputs.to_write(new, index, "id").collect()) == [7, 99]
    assert json.loads(spark.read.json(f"{path}/documents").filter("id = 3").first().document) == {"id": 3, "n": 6}


def test_cohort_and_ledger(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    m = spark.createDataFrame([(1, T0), (2, T0 - timedelta(days=9)), (5, T0)], "id long, played_at timestamp")
    got = outputs.changed_or_new(ids(1, 2, 3), m, ids(1, 2), "id", F.lit(T0 - timedelta(days=1)))
    assert sorted(r.id for r in got.collect()) == [1, 3]
    runs = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.5), ("b", 1, 1.0)], "label string, run int, score double")
    assert sorted((r.label, r.run, r.score_delta) for r in outputs.with_deltas(runs, "label", "run", ["score"]).collect()) == [("a", 1, None), ("a", 2, 2.5), ("b", 1, None)]


def finished(stream, tmp_path, **kinds):
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    q = (writer.foreachBatch(kinds["each"]) if "each" in kinds else writer.format("memory").queryName(kinds["name"])).start()
    q.awaitTermination(120)


def test_throttle_lasts_over_batches(spark, tmp_path):
    src, schema = str(tmp_path / "a"), "box string, kind string, at timestamp, text string"
    at = lambda *minutes: [("b", "down", T0 + timedelta(minutes=m), str(m)) for m in minutes]
    for part in (at(0, 10, 29), at(30, 31), at(59, 61)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    finished(upkeep.throttled(s), tmp_path, name="alerts")
    assert sorted(int(r.text) for r in spark.table("alerts").collect()) == [0, 30, 61]


def test_bad_rows_are_kept_apart(spark, tmp_path):
    src = str(tmp_path / "r")
    spark.createDataFrame([(1, 2.0), (2, None), (None, 1.0)], "id long, v double").coalesce(1).write.parquet(src)
    write = upkeep.by_epoch(str(tmp_path / "out"), "id > 0 and v is not null")
    finished(spark.readStream.schema("id long, v double").parquet(src), tmp_path, each=write)
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 1 and spark.read.parquet(str(tmp_path / "out/rejected")).count() == 2


def test_settled_and_newest_and_unparsed(spark):
    g = spark.createDataFrame([("s", T0), ("s", T0 + timedelta(minutes=8)), ("t", T0)], "series string, at timestamp")
    assert sorted((r.series, r.games) for r in upkeep.settled(g).collect()) == [("s", 2), ("t", 1)]
    n = upkeep.newest(spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "host string, at int"), "host", "at")
    assert sorted((r.host, r.at, r.live) for r in n.collect()) == [("x", 2, True), ("y", 1, False)]
    games, done = spark.createDataFrame([(1,), (2,), (3,)], "game_id long"), spark.createDataFrame([(1, 1), (2, 3)], "game_id long, version int")
    assert sorted(r.game_id for r in upkeep.unparsed(games, done, 2).collect()) == [1, 3]
