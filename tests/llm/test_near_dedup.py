import random
from collections import defaultdict

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from arenaflow.llm import near_dedup as nd
from arenaflow.llm.common import hashed


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40), st.integers(0, 12))
def test_banded_alignment_equals_the_full_table(a, b, most):
    want = distance(a, b)
    got = nd.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), most)
    assert got == (want if want <= most else None)


def classes_by_hand(texts):
    """Components of all pairs with similarity 0.8 or more, and of equal word sequences."""
    words = {i: nd.words_of(t) for i, t in texts if t and t.split()}
    root = {i: i for i, _ in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(words)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            longer = max(len(words[i]), len(words[j]))
            if abs(len(words[i]) - len(words[j])) <= 0.2 * longer and top(i) != top(j) and nd.similarity_of(hashed(words[i]), hashed(words[j])) > 0:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i, _ in texts}


def edited(rng, words, share, vocabulary):
    out = []
    for w in words:
        if rng.random() < share:
            out += rng.choice([[], [rng.choice(vocabulary)], [w, rng.choice(vocabulary)]])
        else:
            out.append(w)
    return out


def test_recall_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for g in range(40):
        base = rng.choices(vocabulary, k=rng.randint(30, 300))
        if g % 4 == 0:
            base[10:10] = passage  # shared by many, alike in nothing else
        texts.append(base)
        for _ in range(rng.choice([0, 1, 2, 12])):
            texts.append(edited(rng, base, rng.choice([0, 0.03, 0.06, 0.1]), vocabulary))
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " "), (1003, "one two"), (1004, "ONE  two")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(1003, "one two", "x")], "doc_id long, text string, root string")
    got = nd.classes(df).collect()
    assert len(got) == len(rows) + 1
    got, want = {r.doc_id: r.class_id for r in got}, classes_by_hand(rows)
    assert got[1004] == 1003 and (got[1000], got[1001], got[1002]) == (1000, 1001, 1002)
    members, found = defaultdict(list), defaultdict(list)
    for i in want:
        members[want[i]].append(i)
        found[got[i]].append(i)
    assert all(len({want[i] for i in m}) == 1 for m in found.values())  # no class joins what isn't linked
    links = sum(len(m) - 1 for m in members.values())
    lost = sum(len({got[i] for i in m}) - 1 for m in members.values())
    assert lost <= 0.01 * links, (lost, links)
    kept = nd.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len(set(got.values()))


def test_chains_and_empty(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.root) for r in nd.components(links).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.classes(empty).count() == 0 and nd.keep_first(empty).count() == 0


def test_repeated_id_links_its_texts(spark):
    x, y = "one two three four five six seven", "red green blue black white grey pink"
    rows = [(1, x), (2, x), (2, y), (2, None), (9, y), (7, "alone"), (None, x)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in nd.classes(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (2, 2), (9, 1), (7, 7), (None, None)], key=str)
    assert sorted((r.doc_id for r in nd.keep_first(df).collect()), key=str) == [1, 7, None]


def test_sketch_keeps_order():
    f = nd.multipliers(200)
    a = hashed([f"w{i}" for i in range(100)])
    same = (nd.sketches(a, f) == nd.sketches(a.copy(), f)).mean()
    turned = (nd.sketches(a, f) == nd.sketches(np.r_[a[50:], a[:50]], f)).mean()
    assert same == 1 and 0.2 < turned < 0.8


def classes_of_sharing_pairs(texts):
    """Components of all pairs that share a sketch and are similar: what no cap on partners may lose."""
    words = {i: hashed(t) for i, t in texts.items()}
    keys = {i: set(nd.sketches(w, nd.multipliers()).tolist()) for i, w in words.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if keys[i] & keys[j] and top(i) != top(j) and nd.similarity_of(words[i], words[j]) > 0:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in texts}


def test_all_partners_in_large_buckets_are_compared(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = {}
    base = rng.choices(vocabulary, k=200)
    for i in range(300):  # siblings, many of them unlike the smallest and the largest
        texts[len(texts)] = [rng.choice(vocabulary) if rng.random() < 0.12 else w for w in base]
    passage = rng.choices(vocabulary, k=60)
    for _ in range(60):  # pairs of near copies around a passage that all of them hold
        own = rng.choices(vocabulary, k=25)
        for _ in range(2):
            texts[len(texts)] = passage + [rng.choice(vocabulary) if rng.random() < 0.5 else w for w in own]
    order = list(texts)
    rng.shuffle(order)
    texts = {k: texts[i] for k, i in enumerate(order)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got, least = {r.doc_id: r.class_id for r in nd.classes(df).collect()}, classes_of_sharing_pairs(texts)
    most = classes_by_hand([(i, " ".join(t)) for i, t in texts.items()])
    assert len({(got[i], c) for i, c in least.items()}) == len(set(least.values()))  # no link of texts that share a sketch is lost
    assert len({(most[i], c) for i, c in got.items()}) == len(set(got.values()))  # and none is made up


def test_rarest_words_are_shared_by_all_similar_texts():
    rng = random.Random(5)
    for _ in range(300):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 20, 400]))]
        a = rng.choices(vocabulary, k=rng.randint(1, 60))
        b = edited(rng, a, 0.15, vocabulary + ["new"])
        if not b or nd.similarity_of(hashed(a), hashed(b)) == 0:
            continue
        known = nd.word_labels(" ".join(rng.choices(vocabulary, k=30)))
        known = np.unique(known[rng.randint(0, 29) :])
        rng.shuffle(known)
        if len(a) >= 5 and len(b) >= 5:
            assert len(set(nd.rarest(known, nd.word_labels(" ".join(a)))) & set(nd.rarest(known, nd.word_labels(" ".join(b))))) >= nd.RARE


def test_recall_by_length_at_the_least_similarity():
    """At 20 % edits of all kinds at least 0.9 of the pairs whose own similarity is 0.8 or more share a sketch, in each band of length."""
    rng, factors = random.Random(6), nd.multipliers()
    vocabulary = [f"w{i}" for i in range(3000)]
    for lo, hi in ((10, 15), (15, 20), (20, 40), (40, 51), (51, 64), (64, 120), (120, 400)):
        met = of = 0
        while of < 150:
            a = rng.choices(vocabulary, k=rng.randint(lo, hi))
            b = edited(rng, a, 0.2, vocabulary)
            if not b or not 0 < nd.similarity_of(hashed(a), hashed(b)) <= 0.84:
                continue
            of += 1
            met += bool(set(nd.all_sketches(hashed(a), factors)) & set(nd.all_sketches(hashed(b), factors)))
        assert met >= 0.9 * of, (lo, hi, met / of)


def test_both_alignments_agree():
    rng = random.Random(4)
    for _ in range(20):
        a = [rng.randrange(50) for _ in range(rng.randint(0, 80))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(50) for _ in range(rng.randint(0, 6))]
        want = distance(a, b)
        for most in (want - 1, want, want + 5):
            got = nd.edits_by_bits(np.array(a, np.uint64), np.array(b, np.uint64), most)
            assert got == (want if want <= most else None)
    a = np.array([rng.randrange(400) for _ in range(nd.SHORT + 100)], np.uint64)
    b = np.delete(a, [5, 90, 300])
    assert nd.edits_within(a, b, 10) == nd.edits_by_bits(a, b, 10) == 3


def test_signatures_lack_no_more_bits_than_there_are_edits():
    rng = random.Random(7)
    for _ in range(300):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 40, 4000]))]
        a = rng.choices(vocabulary, k=rng.randint(1, 300))
        b = edited(rng, a, 0.3, vocabulary)
        x, y = (int.from_bytes(nd.signature(nd.word_labels(" ".join(t))).tobytes(), "little") for t in (a, b or ["w"]))
        assert (x & ~y).bit_count() <= distance(a, b or ["w"])


def test_blocks_link_every_text_that_has_a_similar_member():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    base = rng.choices(vocabulary, k=60)
    sides = [[edited(rng, base, 0.14, vocabulary) for _ in range(n)] for n in (40, 70)]
    sides[0].append(rng.choices(vocabulary, k=60))
    left, right = (pd.DataFrame({"id": range(lo, lo + len(s)), "text": [" ".join(t) for t in s]}) for lo, s in zip((0, 1000), sides))
    got = nd.similar_members(left, right)
    similar = {(x, y) for x, a in enumerate(sides[0]) for y, b in enumerate(sides[1], 1000) if nd.similarity_of(hashed(a), hashed(b)) > 0}
    assert set(zip(got["a"], got["b"])) <= similar
    assert sorted(got["a"]) == sorted({x for x, _ in similar}) and 0 < len(got) < 41
    assert len(nd.similar_members(left.head(0), right)) == len(nd.similar_members(left, right.head(0))) == 0


def test_near_copies_make_few_pairs(spark, monkeypatch):
    """A text of a group shares buckets with many smallest and largest ids; what one link has settled makes no pair."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(f"x{rng.randrange(900)}" if rng.random() < 0.04 else w for w in words)) for i in range(300)]
    seen, plain = [], nd.profiled
    monkeypatch.setattr(nd, "profiled", lambda pairs, unique: seen.append(pairs.count()) or plain(pairs, unique))
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 300
    assert sum(seen) <= 3 * 300


def rows_made(plan):
    """The rows that the Generate nodes of an executed plan (not adaptive) have made."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(rows_made(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_in_the_class_of_a_buckets_ends_make_no_rows(spark):
    """A bucket is open for one stranger's sake: its pairs are made, and no row for the many that are in one class already."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for size in (100, 200):
            texts = spark.createDataFrame([(i, 90, list(range(8))) for i in range(size)], "id long, words int, sketches array<long>")
            state = spark.createDataFrame([(i, 50 if i == 50 else 0) for i in range(size)], "id long, root long")
            pairs = nd.stars(nd.written(nd.still_open(nd.buckets(texts), state), "open"))
            assert sorted((r.a, r.b, r.n) for r in pairs.collect()) == [(0, 50, 8), (50, size - 1, 8)]
            assert rows_made(pairs._jdf.queryExecution().executedPlan()) == 2 * 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def joined_anti(plan):
    """The rows that the left anti joins of an executed plan (not adaptive) have let through."""
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() and "LeftAnti" in plan.simpleString(99) else 0
    return own + sum(joined_anti(plan.children().apply(i)) for i in range(plan.children().size()))


def test_a_pair_is_looked_for_among_the_tried_once(spark):
    """However many sketches it shares."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        alike = nd.profile(np.arange(90, dtype=np.uint64))
        texts = spark.createDataFrame([(i, 90, alike, list(range(8))) for i in range(100)], "id long, words int, profile binary, sketches array<long>")
        state = spark.createDataFrame([(i, i if 50 <= i < 60 else 0) for i in range(100)], "id long, root long")
        shared = nd.written(nd.still_open(nd.buckets(texts), state), "open")
        pairs = nd.candidates(shared, texts, spark.createDataFrame([(0, 50)], "a long, b long"))
        want = [(0, i, 8) for i in range(51, 60)] + [(i, 99, 8) for i in range(50, 60)]
        assert sorted((r.a, r.b, r.n) for r in pairs.collect()) == want
        assert joined_anti(pairs._jdf.queryExecution().executedPlan()) == len(want)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_keys_of_the_same_texts_count_as_one_with_their_number(spark):
    rows = [(i, 60, i, key) for key in range(40) for i in range(5)] + [(i, 60, i, 99) for i in (1, 2)]
    member = nd.sized(spark.createDataFrame(rows, "id long, words int, root long, key long"))
    assert sorted((r.id, r.key, r.weight) for r in member.collect()) == [(0, 0, 40), (1, 0, 40), (1, 99, 1), (2, 0, 40), (2, 99, 1), (3, 0, 40), (4, 0, 40)]
    asked = lambda least: {(r.x, r.root) for r in nd.touched(member, least).collect()}
    assert {frozenset(p) for p in asked(40)} == {frozenset((i, j)) for i in range(5) for j in range(i)}
    assert {frozenset(p) for p in asked(41)} == {frozenset((1, 2))}
