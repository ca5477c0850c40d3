from arenaflow.plans import catalog


def test_close_names_without_a_common_start(spark, tmp_path):
    rows = [(1, "abcd"), (2, "xabcd"), (3, "xbcd"), (900, "abcd"), (5, "zz"), (6, ""), (7, "q"), (8, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(sorted((r.a, r.b))) + (r.d,) for r in catalog.QUERIES["fuzzy_levenshtein_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 1), (1, 3, 1), (2, 3, 1), (1, 1, 0), (6, 7, 1)}
