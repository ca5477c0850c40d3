import random

import numpy as np

from arenaflow.llm import decontaminate as dc
from arenaflow.llm.common import hashed


def best_place(item, text):
    """Fewest edits of an item against any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row, old = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return min(row)


def test_recall_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "a"] * 30 + [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 9, 17, 30, 38, 59])))) for k in range(60)] + [(90, None), (91, " "), (92, "…")]
    docs = []
    for d in range(300):
        words = rng.choices(vocabulary, k=rng.randint(5, 200))
        if d % 2:
            _, item = items[rng.randrange(60)]
            share, part = rng.choice([0, 0.05, 0.1, 0.15]), []
            for w in item.split():
                other = rng.choice(vocabulary)
                part += [w] if rng.random() > share else rng.choice([[other], [], [w, other], [other, w]])
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, ", ".join(words).title() if d % 3 else " ".join(words)))
    df = spark.createDataFrame([(d, t, 0) for d, t in docs] + [(500, None, 0), (501, "", 0), (1, docs[1][1], 0)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, lang string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.find_leaks(df, bench).collect()}
    want = {}
    for d, t in docs:
        for k, i in items[:60]:
            w = dc.words_of(i)
            cost = best_place(w, dc.words_of(t))
            if cost <= int(0.2 * len(w) + 1e-9):
                want[d, k] = cost
    assert set(got) <= set(want)
    assert len(got) >= 0.98 * len(want), (len(got), len(want), [(k, want[k], len(items[k[1]][1].split())) for k in set(want) - set(got)][:9])
    assert all(got[k] >= want[k] for k in got) and np.mean([got[k] == want[k] for k in got]) > 0.98
    kept = dc.without_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in df.collect()} - {d for d, _ in got}
    blocks = {(r.doc_id, r.item_id): r.distance for r in dc.find_leaks(df, bench, block_chars=900).collect()}
    assert blocks == got
    assert dc.find_leaks(df.filter("false"), bench).count() == 0 and dc.find_leaks(df, bench.filter("false")).count() == 0


def test_ids_of_any_kind(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(None, item), (2**53 + 1, item + " eleven")], "item_id long, text string")
    rows = [(2**53 + 1, f"x {item} eleven y"), (None, "clean"), (None, f"a {item} b"), (-5, item), (-5, "clean too"), (2**53, "also clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    assert got == {(i, k) for i in (2**53 + 1, None, -5) for k in (None, 2**53 + 1)}
    kept = sorted(((r.doc_id, r.text) for r in dc.without_leaks(docs, bench).collect()), key=str)
    assert kept == sorted([(None, "clean"), (-5, "clean too"), (2**53, "also clean")], key=str)
    named = spark.createDataFrame([("a", item), (None, "clean")], "doc_id string, text string")
    assert [(r.doc_id, r.distance) for r in dc.find_leaks(named, bench.limit(1)).collect()] == [("a", 0)]
    assert dc.find_leaks(named, bench).schema["doc_id"].dataType.simpleString() == "string"


def test_alignment_equals_the_full_table():
    rng = random.Random(1)
    items = [[rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(50)]
    texts = [[rng.choice("abcd") for _ in range(rng.randint(1, 20))] for _ in range(50)]
    got = dc.align([hashed(i) for i in items], [hashed(t) for t in texts])
    assert [g[0] for g in got] == [best_place(i, t) for i, t in zip(items, texts)]


def test_close_windows_share_more_keys_than_others():
    rng = random.Random(2)
    a = [f"w{rng.randrange(500)}" for _ in range(40)]
    near = [*a[:20], "x", *a[21:]]
    other = [f"w{rng.randrange(500)}" for _ in range(40)]
    keys = [dc.embedded_keys(hashed(x), np.array([0]), np.array([40]))[0] for x in (a, near, other)]
    assert (keys[0] == keys[1]).sum() >= 5 and (keys[0] == keys[2]).sum() == 0
