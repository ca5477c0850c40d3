import math
import random

import numpy as np

from arenaflow.llm import mixing as mx

ROWS = [(i, " ".join(["w"] * (3 + i % 7)) + (" | x" if i % 5 == 0 else ""), f"s{(i * i) % 11 % 4}", ["en", "de", None][(i // 3) % 3]) for i in range(600)]
SCHEMA = "doc_id long, text string, source string, lang string"


def by_hand(cells, targets, rounds=30):
    w = {k: float(t) for k, t in cells.items()}
    for _ in range(rounds):
        for m in range(3):
            now = {}
            for k, x in w.items():
                now[k[m]] = now.get(k[m], 0) + x
            w = {k: x * targets[m][k[m]] / now[k[m]] for k, x in w.items()}
    return w


def test_raking_equals_plain_fitting(spark):
    docs = mx.with_topics(spark.createDataFrame(ROWS, SCHEMA))
    cells = docs.groupBy(*mx.MARGINS).agg(mx.F.sum("tokens").alias("tokens"))
    targets = {"source": mx.tempered(cells, "source", 0.5), "lang": mx.given(cells, "lang", {"en": 0.5, "xx": 0.2}), "topic": mx.tempered(cells, "topic", 0.5)}
    plain = [{r[0]: r[1] for r in t.collect()} for t in targets.values()]
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in plain)
    got = {(r.source, r.lang, r.topic): r.weight for r in mx.rake(cells, targets).collect()}
    want = by_hand({(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}, plain)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in got)
    for m in range(3):
        for value, share in plain[m].items():
            assert abs(sum(x for k, x in got.items() if k[m] == value) - share) < 1e-4


def test_sample(spark):
    docs = spark.createDataFrame(ROWS + [(900, None, None, None), (901, "", "s1", "en"), (3, *ROWS[3][1:])], SCHEMA).selectExpr("*", "1 as weight", "'t' as topic", "9 as tokens")
    got = mx.mix(docs, share=0.5).collect()
    assert all(0 < r.probability <= 1 and abs(r.weight * r.probability - 1) < 1e-9 for r in got)
    tokens = sum(len((t or "").split()) for _, t, _, _ in ROWS)
    assert abs(sum(r.tokens for r in got) - 0.5 * tokens) < 0.1 * tokens
    again = mx.mix(docs.repartition(7), share=0.5).collect()
    assert sorted(r.doc_id for r in again) == sorted(r.doc_id for r in got)
    assert mx.mix(docs.filter("false")).count() == 0
    assert mx.mix(docs, share=0.0).count() == 0
    assert mx.mix(docs, share=1.5).count() == sum(len((t or "").split()) > 0 for _, t, _, _ in ROWS) + 1


def test_very_long_text_and_one_topic(spark):
    rows = [(1, "word " * 200_000, "a", "en"), (2, "word", "a", "en"), (3, "word", "b", None)]
    got = {r.doc_id: r for r in mx.mix(spark.createDataFrame(rows, SCHEMA), share=1.0).collect()}
    assert got[1].tokens == 200_000 and {r.topic for r in got.values()} == {"0"} and len(got) == 3


def topics_by_hand(texts):
    """Lloyd's rounds in plain Python numbers over different vectors; ``texts`` is a list."""
    from arenaflow.llm.common import hashed

    vectors = {}
    for t in texts:
        h = [int(x) % mx.DIMS for x in hashed([w.lower() for w in (t or "").split()])]
        if h:
            vectors[t] = tuple(round(math.sqrt(h.count(d)) / math.sqrt(len(h)) * mx.UNIT) for d in range(mx.DIMS))
    return vectors


def test_whole_query_equals_plain_computation(spark):
    rng = random.Random(3)
    pools = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    rows = [(i, " ".join(rng.choices(rng.choice(pools), k=rng.randint(0, 40))), f"s{i % 3}", ["en", "de", "xx", None][i % 4]) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(5)
    rows = rows + rows[:20]
    got = sorted(mx.mix(docs).collect(), key=lambda r: r.doc_id)
    vectors = topics_by_hand([t for _, t, _, _ in rows])
    marks = {}
    for r in spark.createDataFrame([(bytearray(np.array(v, "<i4").tobytes()),) for v in set(vectors.values())], "vector binary").selectExpr("xxhash64(vector) m", "vector").collect():
        marks[r.m] = tuple(np.frombuffer(bytes(r.vector), "<i4").tolist())
    centres = sorted(marks[m] for m in sorted(marks)[: mx.TOPICS])
    near = lambda v: min(range(len(centres)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(v, centres[k])), k))
    for _ in range(mx.LLOYD):
        own = [[vectors[t] for _, t, _, _ in rows if t in vectors and near(vectors[t]) == k] for k in range(len(centres))]
        centres = [tuple(sum(x) // len(o) for x in zip(*o)) if o else c for o, c in zip(own, centres)]
    topic = {t: str(near(v)) for t, v in vectors.items()}
    cells = {}
    for _, t, s, lang in rows:
        key = s, lang, topic.get(t)
        cells[key] = cells.get(key, 0) + len(t.split())
    live, total = {k: n for k, n in cells.items() if n}, sum(cells.values())

    def sums(m):
        out = {}
        for k, n in live.items():
            out[k[m]] = out.get(k[m], 0) + n
        return out

    powered = [{v: n**mx.POWER for v, n in sums(m).items()} for m in (0, 2)]
    targets = [{v: x / sum(p.values()) for v, x in p.items()} for p in powered]
    free = {v: n for v, n in sums(1).items() if v not in mx.LANGUAGES}
    shares = {v: mx.LANGUAGES.get(v, (1 - sum(mx.LANGUAGES.values())) * n / sum(free.values())) for v, n in sums(1).items()}
    weights = by_hand(live, [targets[0], {v: x / sum(shares.values()) for v, x in shares.items()}, targets[1]], 200)
    lo, hi = 0.0, 1e9
    for _ in range(200):  # the scale at which expected tokens are half of all
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1.0, weights[k] / n * mid) * n for k, n in live.items()) < 0.5 * total else (lo, mid)
    p = {k: min(1.0, weights[k] / n * lo) for k, n in live.items()}
    drawn = {r.doc_id: r.u for r in docs.select("doc_id", mx.uniform("doc_id", 7).alias("u")).collect()}
    want = [(i, s, lang, topic.get(t), len(t.split()), p.get((s, lang, topic.get(t)), 0.0)) for i, t, s, lang in rows]
    want = sorted((w for w in want if drawn[w[0]] < w[5]), key=lambda w: w[0])
    assert [(r.doc_id, r.source, r.lang, r.topic, r.tokens) for r in got] == [w[:5] for w in want] and len(got) > 50
    assert all(abs(r.probability - w[5]) < 1e-4 for r, w in zip(got, want))


def test_calibrated_probabilities_meet_the_budget(spark):
    cells = spark.createDataFrame([("a", "en", "x", 100, 0.8), ("b", "en", "x", 900, 0.1), ("c", "en", "x", 500, 0.1), ("d", "en", "x", 0, 0.0)], "source string, lang string, topic string, tokens long, weight double")
    p = {r.source: r.probability for r in mx.calibrated(cells, 700.0).collect()}
    assert p["a"] == 1 and p["d"] == 0 and np.isclose(100 * p["a"] + 900 * p["b"] + 500 * p["c"], 700) and np.isclose(900 * p["b"], 500 * p["c"])


def test_a_round_reads_its_cells_once(spark, monkeypatch):
    """With joins inside a round each margin's sums read all that came before anew; many cells give the same weights."""
    cells = spark.createDataFrame([(f"s{i % 5}" if i % 5 else None, f"l{i % 3}", str(i % 4), 1 + i * i % 17) for i in range(60)], "source string, lang string, topic string, tokens long")
    cells = mx.written(cells.groupBy(*mx.MARGINS).agg(mx.F.sum("tokens").alias("tokens")), "cells")
    targets = {m: mx.tempered(cells, m, 0.5) for m in mx.MARGINS}
    plans, write = [], mx.written
    monkeypatch.setattr(mx, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    few, many = ({tuple(r[m] for m in mx.MARGINS): r.weight for r in mx.rake(cells, targets, most=n).collect()} for n in (1000, 0))
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few)
    assert plans and all(p.count("Relation [") <= 2 for p in plans) and any(p.count("Relation [") == 1 for p in plans)
