from arenaflow.plans import catalog


def test_real_prices_of_all_customers_are_used(spark, sf_dir):
    lines, orders, customers = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("lineitem", "orders", "customer"))
    cells = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    real = cells.selectExpr("l_suppkey", "c_nationkey % 5").distinct().count()
    assert catalog.QUERIES["cross_fallback_all"](spark, sf_dir).filter("not estimated").count() == real
