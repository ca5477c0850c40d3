"""The paged source: batch, pruning, broken pages, and a stream that goes on where it stopped."""

import json

import pytest
from pyspark.sql import functions as F

from arenaflow.sources import paged


def put(path, n, content):
    (path / f"page-{n:06d}.json").write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture
def feed(spark, tmp_path):
    paged.register(spark)
    path = tmp_path / "feed"
    path.mkdir()
    put(path, 1, [{"id": 1, "at": "2024-01-01", "name": "a", "more": {"x": 1}}, {"id": 2, "at": "2024-01-02", "ok": True}])
    put(path, 2, {"rows": [{"id": "three", "at": "2024-01-03"}]})
    put(path, 4, "{broken")
    put(path, 5, [])
    put(path, 7, [{"id": 6, "at": None, "score": 2}])
    (path / "other.txt").write_text("x")
    return path


SCHEMA = "id long, at string, ok boolean, score double, more string, _broken string"


def read(spark, path, schema=SCHEMA, **options):
    return spark.read.format("arena_pages").schema(schema).options(path=str(path), **options).load()


def test_batch(spark, feed):
    df = read(spark, feed, pages=2)
    got = sorted(df.collect(), key=str)
    assert len(got) == 5 and df.rdd.getNumPartitions() == 3
    assert {r.id for r in got} == {1, 2, 6, None} and [r._broken for r in got if r._broken] == ["{broken"]
    assert next(r for r in got if r.id == 1).more == '{"x": 1}' and next(r for r in got if r.id == 6).score == 2.0 and next(r for r in got if r.id == 2).ok is True
    assert sorted(r.id for r in read(spark, feed, "id long").filter("id is not null").collect()) == [1, 2, 6]
    assert df.select("id").filter(F.col("at") > "2024-01-01").count() == 2


def test_high_water_mark(spark, feed):
    got = read(spark, feed, "id long, at string", order="at", since="2024-01-01").collect()
    assert sorted(r["at"] for r in got) == ["2024-01-02", "2024-01-03"]


def test_types_that_pages_dont_hold(spark, feed):
    with pytest.raises(Exception, match="aren't read from pages"):
        read(spark, feed, "id array<long>").collect()


def test_empty_folder(spark, tmp_path):
    paged.register(spark)
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0


def test_stream_goes_on_behind_its_offset(spark, feed, tmp_path):
    def run():
        src = spark.readStream.format("arena_pages").schema(SCHEMA).options(path=str(feed), limit=2).load()
        q = src.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(str((r.id, r._broken)) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())

    first = run()
    assert first == sorted(str((r.id, r._broken)) for r in read(spark, feed).collect())
    assert run() == first
    put(feed, 8, [{"id": 9}])
    assert run() == sorted([*first, str((9, None))])
