import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from arenaflow.llm import decontaminate, near_dedup, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "mixing"] and cp.ORACLE_SQL is None
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and [t for _, t in df.dtypes] == [t for _, t in stages[0].dtypes]


def test_every_decision_takes_effect(spark, stages):
    docs, good, firsts, clean, private, mixed = stages
    scored = quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(good) == ids(scored.filter("predicted = 1"))
    classes = near_dedup.classes(good)
    assert ids(firsts) == sorted({r.class_id for r in classes.collect()})
    leaks = {r.doc_id for r in decontaminate.find_leaks(firsts, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(clean) == [i for i in ids(firsts) if i not in leaks]
    assert ids(private) == ids(clean)
    again = pii.summary(private).agg(F.sum("n_email"), F.sum("n_ip"), F.sum("n_card"), F.sum("n_phone")).first()
    assert set(again) == {0}
    changed = clean.join(private.select("doc_id", F.col("text").alias("new")), "doc_id").filter("text <> new").count()
    assert changed == pii.summary(clean).filter("spans <> ''").count()
    assert set(ids(mixed)) <= set(ids(private)) and 0 < mixed.count()


def test_run_gives_the_last_stage(spark, stages):
    assert ids(cp.run(spark, SF)) == ids(stages[-1])


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "plain words only here", None, "s", 21), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        for j, d in enumerate((docs, docs.filter("false"))):
            out = stage(spark, d, SF)
            assert out.columns == docs.columns and out.count() <= d.count()
    assert cp.STAGES[-1][1](spark, docs, SF).count() >= 0


def test_python_gets_few_whole_texts_at_a_time(spark, monkeypatch):
    """What reads texts in Python is written with small batches, so that workers (which keep their memory) stay small."""
    from arenaflow.llm import decontaminate, mixing, quality

    seen = {}

    def noted(df, name, write=quality.written):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return write(df, name)

    for module in (quality, mixing, decontaminate):
        monkeypatch.setattr(module, "written", noted)
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    quality.score_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    mixing.with_topics(docs)
    decontaminate.find_leaks(docs, spark.createDataFrame([(1, "words of some benchmark item in full")], "item_id long, text string"))
    assert {seen[n] for n in ("stats", "vectors", "leaks")} == {1000}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
