from arenaflow.plans import catalog


def test_benchmark_takes_every_customer(spark, sf_dir):
    got = catalog.QUERIES["benchmark_fallback_all"](spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert got.count() == orders.select("o_custkey", "o_orderpriority").distinct().count()
    assert {r.fine for r in got.select("fine").distinct().collect()} == {True, False}
