import zlib

import numpy as np
import pandas as pd

from arenaflow.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = q.score_quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = both[both.quality == 1]["score"], both[both.quality == 0]["score"]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and (both["predicted"] == both["quality"]).mean() > 0.95


def test_scores_do_not_depend_on_other_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    a = {r.doc_id: r.score for r in q.score_quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in q.score_quality(docs.selectExpr("doc_id", "text", "'x' lang", "1.0 score", "2 quality"), labels).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " \n", "word", "x " * 50_000, "😀é"])] + [(3, "word")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (3, 1), (4, None), (99, 0)], "doc_id long, quality int")
    rows = q.score_quality(docs, one).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert q.score_quality(docs.filter("false"), one).count() == 0
    assert q.keep_good(docs, none).count() == 7


def test_isotonic_fit_against_brute_force():
    rng = np.random.default_rng(0)
    total = rng.integers(0, 4, 30)
    good = rng.binomial(total, np.linspace(0.1, 0.9, 30))
    fit = q.pooled(good, total)
    assert (np.diff(fit) >= -1e-12).all()
    at = np.flatnonzero(total)
    want = [max(min(good[i : j + 1].sum() / total[i : j + 1].sum() for j in at if j >= k) for i in at if i <= k) for k in at]  # max-min form
    assert np.allclose(fit[at], want)


def test_normal_equations_equal_one_sum(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, len(q.STATISTICS))), rng.integers(0, 2, 200).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"stats": x.tolist(), "quality": y})).repartition(5)
    model = q.Model(x.mean(0), x.std(0), np.zeros(q.FEATURES + 1), np.zeros(q.GRID))
    a, b = q.gram(df, model)
    f = model.features(x)
    assert np.allclose(a, f.T @ f) and np.allclose(b, f.T @ y)


def test_whole_query_equals_plain_computation(spark):
    """All documents of a table, with one matrix of all features and the max-min form of the isotonic fit."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = q.score_quality(docs, labels).toPandas().set_index("doc_id")
    rows = docs.select("doc_id", "text").toPandas()
    stats = np.array([q.statistics(t or "") for t in rows["text"]])
    fold = rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5).to_numpy()
    label = rows["doc_id"].map(labels.toPandas().set_index("doc_id")["quality"]).to_numpy(float)
    learn, calibrate = np.isin(label, (0, 1)) & (fold > 0) & (fold < 4), np.isin(label, (0, 1)) & (fold == 4)
    mean, scale = stats[learn].mean(0), np.maximum(stats[learn].std(0), 1e-6)
    directions, phases = q.frequencies(stats.shape[1])
    waves = np.sqrt(2 / len(phases)) * np.cos(np.clip((stats - mean) / scale, -8, 8) @ directions + phases)
    x = np.hstack([waves, np.ones((len(stats), 1))])
    penalty = np.diag([q.RIDGE] * len(phases) + [1e-9])
    raw = x @ np.linalg.solve(x[learn].T @ x[learn] + penalty, x[learn].T @ label[learn])
    cells = q.cell(raw)
    at = np.unique(cells[calibrate])
    good = np.array([label[calibrate & (cells == c)].sum() for c in at])
    many = np.array([(calibrate & (cells == c)).sum() for c in at])
    fit = [max(min(good[i : j + 1].sum() / many[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    want = np.array(fit)[np.maximum(np.searchsorted(at, cells, side="right") - 1, 0)]
    score = got.loc[rows["doc_id"], "score"].to_numpy()
    # a raw score at the edge of a cell may fall to either side with another order of summing
    assert (np.abs(score - want) < 1e-9).mean() > 0.995
    assert (got.loc[rows["doc_id"], "predicted"].to_numpy() == (score >= 0.3)).all()
