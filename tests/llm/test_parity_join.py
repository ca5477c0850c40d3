"""The parity-sketch join against all pairs."""

import random
import re

import numpy as np
import pytest

from arenaflow.llm import parity_join as pj


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(rows):
    """(id, n_shingles, component) of every row by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (rows[i][0] == rows[j][0] or 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both)):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_shingles int, key string")
    return sorted(tuple(r) for r in pj.join_classes(docs).collect())


def edited(rng, words, most):
    words = list(words)
    for _ in range(rng.randint(0, most)):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def families(seed):
    """Texts of 1 to 400 words in groups around the least similarity, with shared passages and short texts."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    passage = rng.choices(words, k=25)
    out = []
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 5, 9, 10, 11, 12, 13, 20, 21, 40, 90, 150, 400]))
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 2, 6])):
            text = edited(rng, base, max(1, len(base) // 50))
            if rng.random() < 0.3:
                text = text[rng.randrange(1 + len(text) // 12) :]
            out.append(" ".join(text))
    return out


def test_a_pair_that_links_shares_a_key():
    """At every size and at the largest difference, however it falls: to one side or to both."""
    rng = np.random.default_rng(1)
    for n in (9, 10, 11, 12, 13, 15, 16, 19, 20, 28, 38, 57, 100, 190, 700):
        for _ in range(80):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            lost = int(rng.integers(0, n // 10 + 1))
            won = max(k for k in range(n) if pj.DIFFERENCE * (lost + k) <= 2 * n - lost + k or k == 0)
            b = np.unique(np.r_[a[lost:], rng.integers(0, 2**63, won, dtype=np.uint64)])
            if pj.DIFFERENCE * (lost + won) <= len(a) + len(b) and lost + won:
                assert np.intersect1d(pj.keys_of(a), pj.keys_of(b)).size


def test_sketches_fold_and_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((100, 130), (500, 520), (4000, 4090)):
        common = rng.integers(0, 2**63, n - 10, dtype=np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, k - n + 10, dtype=np.uint64)]) for k in (n, m))
        x, y = (np.frombuffer(pj.sketch_of(s), "<u8")[None, :] for s in (a, b))
        for words in [w for w in (4, 8, 16, 64) if w <= min(x.shape[1], y.shape[1])]:
            distance = np.bitwise_count(pj.folded(x, words) ^ pj.folded(y, words)).sum()
            assert distance <= len(np.setxor1d(a, b)) and (len(np.setxor1d(a, b)) - distance) % 2 == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = list(enumerate(families(seed)))
    assert run(spark, rows) == plain(rows)


def test_chain_of_near_copies_and_its_siblings(spark):
    """Each links with the next one only, and many texts share most runs without a link: nothing is lost, nothing is added."""
    rng = random.Random(3)
    chain = [rng.choices([f"c{i}" for i in range(300)], k=120)]
    for _ in range(12):
        chain.append(chain[-1][:-4] + [f"n{rng.randrange(10**6)}" for _ in range(4)])
    base = rng.choices([f"s{i}" for i in range(300)], k=140)
    siblings = [[f"x{k}y{j}" if j in places else w for j, w in enumerate(base)] for k in range(120) for places in [set(rng.sample(range(140), 6))]]
    rows = list(enumerate(" ".join(t) for t in chain + siblings))
    got = run(spark, rows)
    assert got == plain(rows) and {c for i, _, c in got if i < 13} == {0}


def test_blocks_of_all_sizes_agree(spark, monkeypatch):
    rng = random.Random(4)
    base = rng.choices([f"s{i}" for i in range(300)], k=60)
    rows = list(enumerate(" ".join(edited(rng, base, 3)) for _ in range(150)))
    want = plain(rows)
    monkeypatch.setattr(pj, "BLOCK", 7)
    assert run(spark, rows) == want


def test_words_and_cases(spark):
    rows = [
        (1, "a b c d"), (2, "A B\tC\x0bD"), (3, "a b c d"), (4, "a b\x1cc d"), (5, "É b c d"), (6, "é b c d"), (7, None), (8, ""), (9, " \n"),
        (10, "a b"), (11, "A  b"), (12, "a"), (13, "a b c d e f g h i j k l"), (13, "other words of the same id"), (14, "other words of the same id"),
        (1, "a b c d"), (15, "퟿ \U0001f600 x"), (16, "x " * 200_000),
    ]
    assert run(spark, rows) == plain(rows)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, map(tuple, pj.join_classes(docs).collect()))) == ["(3, 2, 3)", "(None, 0, None)", "(None, 2, None)"]
    assert pj.join_classes(docs.filter("false")).count() == 0
