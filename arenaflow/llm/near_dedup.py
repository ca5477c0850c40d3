"""Near-duplicate classes with Order MinHash, verified by banded alignment.

A document is its sequence of lower-case words. Its runs of five words are labelled with their occurrence number; each of SKETCHES hash
functions samples the PICKED smallest labelled runs and keeps them in text order, so that equal sketches mean equal runs in equal
order (Order MinHash, sensitive to edit similarity). In texts of at most FEW words a single edit can touch most runs of five, so they
get SHORT_SKETCHES more functions over runs of SHORT_RUN words.

Different texts that share a sketch are compared with the smallest and the largest of the bucket first (a star, linear in the bucket's
size). The candidate with which a text shares most sketches is verified first; the others are made only of buckets, and for texts, that the
classes found so far don't connect already. Every pair that shares a sketch and is still in different classes then has its turn, a text with a whole class at a
time: directly where a bucket has at most OUTSIDERS members outside its largest class, else by a join that loses no similar pair and doesn't
grow with the square of the bucket: texts within d edits share RARE of their d + RARE rarest words (each word labelled with its occurrence number, rarity
being one order for all texts), so the texts of such buckets meet by those words, unless a signature of the words rules the similarity out. A
text and a large class are compared where both are, block by block, until one similar member is found. Two texts are linked if their word edit
similarity, 1 - edits / longer length, is at least 0.8; the alignment fills only the diagonals that the allowed edits reach.
Classes are the connected components of the links, and exact copies (equal word sequences) share a class by their digest before any search.

Recall is measured in tests/llm by length from 10 words on, at 20 % edits of all kinds, the least similarity that counts.

Scale: a text is read once for the sketches and once more for candidates; sketches are hashes of 8 bytes; buckets are reduced by
partial sums and skew joins, never collected; a third of all rows in one bucket gives one row each. Keys with more than a HEAVY-th of
all rows (so at most HEAVY keys) are joined by broadcast in the components. The rarest words need one order only, so that of words
the FREQUENT most frequent ones are known to every task and all others count as equally rare.

Cases: null texts and texts without words are classes of their own; texts under five words are one run; an id that repeats with
different texts links their classes (rows of it without words stay apart); repeated rows each give a row; ids are integers; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.llm.common import arrow_rows, chunks, counted, hashed, text_or_empty, written
from arenaflow.shared import forget

RUN, SKETCHES, PICKED, SIMILARITY, SEED = 5, 80, 2, 0.8, 5
#: Texts of at most FEW words have further sketches, over shorter runs.
FEW, SHORT_RUN, SHORT_SKETCHES = 50, 2, 32
SKETCHED = "digest string, words int, profile binary, sketches array<long>"
#: Classes of words in a document's profile, and how many ids may be broadcast (16 bytes each).
CLASSES, SMALL = 256, 1_000_000
#: Texts up to so many words are aligned with bits of integers: faster there where the edits are many.
SHORT = 600
#: Words whose hashes a batch of pairs keeps.
KEPT = 1_000_000
#: Texts and words in each side of a block of texts and members; pairs of a text that the first round of verifying takes.
BLOCK, BLOCK_WORDS, FIRST_ROUND = 64, 100_000, 8
#: Members outside its largest class up to which a bucket's classes meet directly (and members of a class that is joined row by row); words
#: whose frequency every task knows.
OUTSIDERS, FREQUENT = 16, 50_000
#: Rare words that two similar texts must share; different texts of fewer than five words can't be similar, and others share as many.
RARE = 2
#: Long integers whose bits tell which labelled words a text has.
SIGNATURE = 8
#: Keys with more than this part of a table's rows are joined by broadcast.
HEAVY = 1000


def words_of(text: str) -> list[str]:
    return text.lower().split()


def multipliers(n: int = SKETCHES) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_runs(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of every run of so many words with its occurrence number (shorter texts: one run)."""
    n = max(1, len(words) - run + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(run, len(words))):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    first = np.r_[True, sorted_h[1:] != sorted_h[:-1]]
    nth = np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = nth
    return mixed(h + occurrence * np.uint64(0xD6E8FEB86659FD93))


def sketches(words: np.ndarray, factors: np.ndarray, run: int = RUN) -> np.ndarray:
    """One hash for each function: of the PICKED smallest labelled runs in text order."""
    runs = labelled_runs(words, run)
    k = min(PICKED, len(runs))
    out = []
    step = max(1, 2_000_000 // len(runs))
    for lo in range(0, len(factors), step):
        values = runs[None, :] * factors[lo : lo + step, None]
        at = np.argpartition(values, k - 1, axis=1)[:, :k] if len(runs) > k else np.tile(np.arange(k), (len(values), 1))
        out.append(runs[np.sort(at, axis=1)])
    picked = np.concatenate(out)
    # lengths within a factor of two share a bucket, with another boundary for each function: what differs more can't be similar
    band = np.floor(np.log2(len(words)) + np.arange(len(factors)) / len(factors)).astype(np.uint64)
    h = mixed((np.arange(len(factors), dtype=np.uint64) * np.uint64(8) + np.uint64(run)) * np.uint64(64) + band)
    for j in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + picked[:, j])
    return h.astype(np.int64)


def all_sketches(words: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Of a text's runs and, if it is short, of its shorter runs."""
    own = sketches(words, factors)
    return np.r_[own, sketches(words, factors[:SHORT_SKETCHES], SHORT_RUN)] if len(words) <= FEW else own


def sketched(texts: pd.Series) -> pd.DataFrame:
    """Digest of the words and the sketches; nulls for texts without words."""
    factors, values, out = multipliers(), texts.tolist(), []
    for lo, hi in chunks(values):
        words = [words_of(t) for t in values[lo:hi]]
        h = hashed([w for ws in words for w in ws])
        ends = np.cumsum([len(ws) for ws in words])
        for ws, end in zip(words, ends):
            digest = hashlib.md5(" ".join(ws).encode("utf-8", "surrogatepass")).hexdigest() if ws else None
            own = h[end - len(ws) : end]
            out.append((digest, len(ws), profile(own), all_sketches(own, factors)) if ws else (None, 0, None, None))
    return pd.DataFrame(out, columns=["digest", "words", "profile", "sketches"])


def profile(words: np.ndarray) -> bytes:
    """How many words fall in each of CLASSES classes."""
    return np.bincount(words >> np.uint64(56), minlength=CLASSES).astype("<u4").tobytes()


def may_be_similar(left: pd.Series, right: pd.Series) -> pd.Series:
    """False only for pairs whose profiles alone need more edits than allowed: classes can't differ more than the words do."""
    a, b = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), CLASSES).astype(np.int64) for s in (left, right))
    longer = np.maximum(a.sum(axis=1), b.sum(axis=1))
    return pd.Series(longer - np.minimum(a, b).sum(axis=1) <= (1 - SIMILARITY) * longer + 1e-9)


def edits_by_bits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance if it is at most ``most``, else None: a column of the full table in two integers (Myers, Hyyro)."""
    n, rest, at = len(a), len(b), {}
    if not n:
        return rest if rest <= most else None
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, edits = full, 0, n
    for w in b.tolist():
        equal = at.get(w, 0)
        v, h = equal | down, (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(h | up)), up & h
        edits += 1 if more & top else -1 if less & top else 0
        rest -= 1
        if edits - rest > most:
            return None
        more = (more << 1 | 1) & full
        up, down = (less << 1 & full) | (full & ~(v | more)), more & v
    return edits if edits <= most else None


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None. The band holds the diagonals within ``most``; for each
    number of edits it keeps the furthest place reached on every diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    ca, cb = (dict(zip(*np.unique(x, return_counts=True))) for x in (a, b))
    if max(n, m) - sum(min(c, cb.get(w, 0)) for w, c in ca.items()) > most:
        return None
    if max(n, m) <= SHORT:
        return edits_by_bits(a, b, most)
    width = 2 * most + 3
    diag = np.arange(width) - most - 1  # place in b minus place in a
    far = np.full(width, -(10**9))
    mid = most + 1
    goal = mid + m - n

    def slide(reach: np.ndarray, live: np.ndarray) -> None:
        """Moves every live diagonal over the equal words that follow."""
        while len(live):
            x = reach[live]
            y = x + diag[live]
            inside = (x < n) & (y < m) & (x >= 0) & (y >= 0)
            live, x, y = live[inside], x[inside], y[inside]
            same = a[x] == b[y]
            live, x, y = live[same], x[same], y[same]
            if len(live) > 4:
                reach[live] += 1
                continue
            for k, i, j in zip(live.tolist(), x.tolist(), y.tolist()):
                size = 32
                while True:
                    stop = min(size, n - i, m - j)
                    unequal = np.flatnonzero(a[i : i + stop] != b[j : j + stop])
                    step = int(unequal[0]) if len(unequal) else stop
                    i, j, size = i + step, j + step, size * 4
                    if len(unequal) or stop == 0 or i == n or j == m:
                        break
                reach[k] = i
            return

    far[mid] = 0
    slide(far, np.array([mid]))
    for e in range(most + 1):
        if far[goal] >= n:
            return e
        new = np.full(width, -(10**9))
        new[1:-1] = np.maximum(np.maximum(far[1:-1] + 1, far[:-2]), far[2:] + 1)
        new = np.minimum(new, np.minimum(n, m - diag))
        live = np.arange(max(1, mid - e - 1), min(width - 1, mid + e + 2))
        slide(new, live)
        far = new
    return None


def similarity_of(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Word edit similarity if it is at least ``least``, else 0."""
    longer = max(len(a), len(b))
    found = edits_within(a, b, int((1 - least) * longer + 1e-9))
    return 0.0 if found is None else 1 - found / longer


def similarity_by_counts(left: tuple, right: tuple) -> float:
    """``similarity_of`` two texts (word hashes, different words and their counts), aligned only if the words in common allow it."""
    (a, ua, na), (b, ub, nb) = left, right
    longer = max(len(a), len(b))
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    possible = longer - np.minimum(na[i], nb[j]).sum() <= int((1 - SIMILARITY) * longer + 1e-9)
    return similarity_of(a, b) if possible else 0.0


def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Of each pair; a text's word hashes and their counts are kept while the pairs of a batch repeat it (up to KEPT words)."""
    known, size, out = {}, 0, []

    def of(text: str):
        nonlocal size
        if text not in known:
            if size > KEPT:
                known.clear()
                size = 0
            words = hashed(words_of(text))
            known[text] = (words, *np.unique(words, return_counts=True))
            size += len(words)
        return known[text]

    for x, y in zip(left, right):
        out.append(similarity_by_counts(of(x), of(y)))
    return pd.Series(out, dtype=float)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs whose texts are similar; ``texts`` has id and text, one row for each id."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("left")), texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("s", F.pandas_udf(similarity, "double")("left", "right")).filter("s > 0").select("a", "b")


def heavy_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The keys (at most HEAVY) that hold more than a HEAVY-th of the ``total`` rows."""
    return written(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > total / HEAVY).select(key), "heavy")


def looked_up(rows: DataFrame, key: str, heavy: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` joined with ``of``, which has one row a key; rows of heavy keys stay where they are."""
    heavy = F.broadcast(heavy)  # at most HEAVY keys, and as many rows of ``of``
    few = F.broadcast(of.join(heavy, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(heavy, key, "left_anti").join(of, key))


def components(links: DataFrame) -> DataFrame:
    """id, root (the smallest id of its component) of every end of ``links`` (a, b). Each round takes the smallest root among the
    neighbours and then the root of that root, until nothing changes."""
    both = links.select(F.col("a").alias("from"), F.col("b").alias("id")).union(links.select("b", "a")).distinct()
    both, total = counted(both, "links", F.lit(True))
    hubs = heavy_keys(both, "id", total)
    state = written(both.groupBy(F.col("from").alias("id")).agg(F.least(F.col("from"), F.min("id")).alias("root")), "roots")
    changed = total
    while changed:
        near = looked_up(both, "id", hubs, state).groupBy(F.col("from").alias("id")).agg(F.min("root").alias("near"))
        step = written(state.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root")), "steps")
        up = step.select(F.col("id").alias("root"), F.col("root").alias("above"))
        # nothing follows this join, so that Spark can split the rows of one root
        new = step.join(up, "root").select("id", "old", F.least("root", "above").alias("root"))
        new, changed = counted(new, "roots", F.col("root") != F.col("old"))
        state = new.select("id", "root")
    return state


def buckets(unique: DataFrame) -> DataFrame:
    """id, words, key and the smallest and largest id of the bucket with their words, for every sketch that several texts share."""
    keys = unique.select("id", "words", F.explode("sketches").alias("key"))
    stars = keys.groupBy("key").agg(
        F.min("id").alias("low"), F.min_by("words", "id").alias("low_words"), F.max("id").alias("high"), F.max_by("words", "id").alias("high_words")
    ).filter("low < high")
    return keys.join(stars, "key")


def profiled(pairs: DataFrame, unique: DataFrame) -> DataFrame:
    """The pairs (a, b, n) whose profiles don't rule the similarity out."""
    left, right = unique.select(F.col("id").alias("a"), F.col("profile").alias("left")), unique.select(F.col("id").alias("b"), F.col("profile").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(F.pandas_udf(may_be_similar, "boolean")("left", "right")).select("a", "b", "n")


def candidates(shared: DataFrame, unique: DataFrame, tried: DataFrame) -> DataFrame:
    """a, b, n: pairs of different texts that share n sketches with a bucket's smallest or largest id between them, without those of ``tried``
    and those whose lengths or profiles rule the similarity out. ``shared`` is of ``buckets``."""
    pairs = written(stars(shared), "met")  # or Spark would look for each of a pair's shared sketches among the tried, before they are one pair
    return profiled(pairs.join(tried, ["a", "b"], "left_anti"), unique)


def stars(shared: DataFrame) -> DataFrame:
    """``candidates`` before ``tried`` and the profiles; of ``still_open`` buckets, the pairs in different classes only. Lengths and classes are looked at
    before a row is made, so that a text whose class its bucket's smallest and largest id have makes none."""
    classed = "root" in shared.columns
    fields = ["words", "root"] if classed else ["words"]
    centres = F.array(*[F.struct(F.col(c).alias("id"), *[F.col(f"{c}_{f}").alias(f) for f in fields]) for c in ("low", "high")])

    def meets(centre: Column) -> Column:
        alike = F.least("words", centre.words) >= SIMILARITY * F.greatest("words", centre.words) - 1e-9
        other = (F.col("id") != centre.id) & alike
        return other & (F.col("root") != centre.root) if classed else other

    rows = shared.select("id", F.explode(F.filter(centres, meets)).alias("centre"))
    a, b = F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")
    return rows.select(a, b).groupBy("a", "b").agg(F.count("*").alias("n"))


def foremost(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each b that which shares most sketches, ties to the smaller a."""
    best = pairs.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("best"))
    return best.select((-F.col("best.a")).alias("a"), "b", F.col("best.n").alias("n"))


def still_open(shared: DataFrame, state: DataFrame) -> DataFrame:
    """The buckets that hold several classes, with the root of each text and of the bucket's smallest and largest id. A bucket's sums tell that
    before any pair of its texts is made."""
    member = shared.join(state, "id")
    several = member.groupBy("key").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.min_by("root", "id").alias("low_root"), F.max_by("root", "id").alias("high_root")
    ).filter("least < most").drop("least", "most")
    return member.join(several, "key")


def class_sizes(member: DataFrame) -> DataFrame:
    """key, major (its largest class), members, outsiders (those of other classes) and weight. The keys of a passage that the same texts hold
    say the same: one of all keys with the same texts (told by two hashes of their ids) stays, their number is its weight."""
    marks = ["mark0", "mark1"]
    by_class = member.groupBy("key", "root").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("id", F.lit(m))).alias(m) for m in marks])
    by_key = by_class.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("outsiders"),
        *[F.bit_xor(m).alias(m) for m in marks])
    return by_key.groupBy("major", "members", "outsiders", *marks).agg(F.min("key").alias("key"), F.count("*").alias("weight")).drop(*marks)


def sized(member: DataFrame) -> DataFrame:
    """``member`` with its key's major, outsiders and weight, without the keys that another stands for."""
    return member.join(class_sizes(member).select("key", "major", "outsiders", "weight"), "key")


def touched(member: DataFrame, least: int = 1, signs: list[str] = ()) -> DataFrame:
    """x, root: texts and the other classes with texts that share ``least`` keys with them and may be as long. ``member`` is of ``sized``
    (and ``signs``, columns of ``signature``: a class lacking more of a text's words than edits are allowed isn't asked); of a key the texts of
    its largest class ask for no other, and of two smaller classes one asks for the other."""
    own = [F.col(s).alias(f"x_{s}") for s in signs]
    outside = member.filter("root <> major").select(
        "key", "major", "weight", F.col("id").alias("x"), F.col("words").alias("n"), F.col("root").alias("x_root"), *own)
    there = member.groupBy("key", "root").agg(F.min("words").alias("shortest"), F.max("words").alias("longest"), *[F.bit_or(s).alias(s) for s in signs])
    fits = (
        (F.col("x_root") != F.col("root")) & ((F.col("root") == F.col("major")) | (F.col("x_root") < F.col("root")))
        & (F.col("n") >= SIMILARITY * F.col("shortest") - 1e-9) & (F.col("longest") >= SIMILARITY * F.col("n") - 1e-9)
    )
    if signs:
        longer = F.least(F.greatest("n", "longest"), F.col("n") / SIMILARITY)
        lacking = sum(F.bit_count(F.col(f"x_{s}").bitwiseAND(F.bitwise_not(s))) for s in signs)
        fits &= lacking <= F.floor((1 - SIMILARITY) * longer + 1e-9)
    return outside.join(there, "key").filter(fits).groupBy("x", "root").agg(F.sum("weight").alias("keys")).filter(F.col("keys") >= least).select("x", "root")


def counted_words(texts: pd.Series) -> list[tuple]:
    """Word hashes, different words and their counts of every text."""
    values, out = texts.tolist(), []
    for lo, hi in chunks(values):
        words = [words_of(t) for t in values[lo:hi]]
        ends = np.cumsum([len(ws) for ws in words])
        out += [(h, *np.unique(h, return_counts=True)) for h in np.split(hashed([w for ws in words for w in ws]), ends[:-1])]
    return out


def similar_members(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """a, b: of each text (id, text) of ``left`` and one of ``right`` that is similar to it, if there is any: as those of ``right`` are of one
    class, more say nothing new. What profiles allow is aligned, most alike first, until one is similar."""
    mine, theirs = counted_words(left["text"]), counted_words(right["text"])
    bins = np.array([np.frombuffer(profile(t[0]), "<u4") for t in theirs], np.int64).reshape(-1, CLASSES)
    lengths, out = bins.sum(axis=1), []
    for x, own in zip(left["id"].tolist(), mine):
        longer = np.maximum(len(own[0]), lengths)
        apart_by = longer - np.minimum(np.frombuffer(profile(own[0]), "<u4").astype(np.int64), bins).sum(axis=1)
        at = np.flatnonzero(apart_by <= (1 - SIMILARITY) * longer + 1e-9)
        for k in at[np.argsort(apart_by[at] / longer[at], kind="stable")].tolist():
            if similarity_by_counts(own, theirs[k]):
                out.append((x, right["id"].iat[k]))
                break
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def with_members(asked: DataFrame, state: DataFrame, unique: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The texts of ``asked`` (x, root) with the members of those classes. Classes of a few members are joined: pairs a, b, n as far as
    lengths and profiles allow the similarity. With larger ones texts are compared in blocks of at most about BLOCK texts and BLOCK_WORDS
    words a side, which give links (a, b), at most one for a text and block; None without such classes."""
    words = unique.select("id", "words")
    many = asked.join(words, F.col("x") == F.col("id")).groupBy("root").agg(F.count("*").alias("askers"), F.sum("words").alias("asking"))
    sizes = state.join(words, "id").groupBy("root").agg(F.count("*").alias("members"), F.sum("words").alias("held"))
    sizes = written(sizes.join(many, "root"), "classes")
    low, high = F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")
    few = sizes.filter(F.col("members") <= OUTSIDERS).select("root")
    pairs = profiled(asked.join(few, "root", "left_semi").join(state, "root").select(low, high).distinct().withColumn("n", F.lit(100)), unique)
    large = sizes.filter(F.col("members") > OUTSIDERS).selectExpr(
        "root", f"ceil(greatest(askers / {BLOCK}, asking / {BLOCK_WORDS})) as ps", f"ceil(greatest(members / {BLOCK}, held / {BLOCK_WORDS})) as qs")
    if not large.limit(1).count():
        return pairs, None
    x = asked.join(large, "root").selectExpr("root", "pmod(xxhash64(x), ps) as p", "explode(sequence(0L, qs - 1)) as q", "x as id")
    y = state.join(large, "root").selectExpr("root", "explode(sequence(0L, ps - 1)) as p", "pmod(xxhash64(id), qs) as q", "id")
    x, y = written(x, "askers"), written(y, "members")
    texts = written(texts_of(base, x.select("id").union(y.select("id")).distinct(), unique), "block_texts")
    by = ["root", "p", "q"]
    renewed = [F.col(c).alias(c) for c in (*by, "id", "text")]  # columns of its own for each side of the cogroup
    sides = [side.join(texts, "id").select(*renewed).groupBy(*by) for side in (x, y)]
    return pairs, sides[0].cogroup(sides[1]).applyInPandas(similar_members, "a long, b long")


def word_labels(text: str) -> np.ndarray:
    """A hash of each word with its occurrence number."""
    return labelled_runs(hashed(words_of(text)), 1)


def labels_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: word_labels(t).view(np.int64))


def signature(labels: np.ndarray) -> np.ndarray:
    """SIGNATURE integers with a bit for every label (a label has one bit, which others may have too): a partner within d edits has
    all but d of the labels, so that no more than d bits are missing in its signature."""
    bits = np.zeros(64 * SIGNATURE, np.uint8)
    bits[(labels >> np.uint64(32)) % np.uint64(64 * SIGNATURE)] = 1
    return np.packbits(bits).view(np.int64)


def rarest(known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The d + RARE rarest labelled words of a text that allows d edits; ``known``: the frequent ones, most frequent last. A partner
    within d edits has all but d of the text's labels (a longer one allows more edits by as many words as it is longer, at least),
    and so the RARE rarest labels that both have are among the first d + RARE of either."""
    order = np.argsort(known, kind="stable")
    at = np.minimum(np.searchsorted(known, labels, sorter=order), max(len(known) - 1, 0))
    place = np.where(known[order[at]] == labels, order[at] + 1, 0) if len(known) else np.zeros(len(labels), int)
    first = np.lexsort((labels, place))[: int((1 - SIMILARITY) * len(labels) + 1e-9) + RARE]
    return labels[first].view(np.int64)


def signs() -> list[str]:
    return [f"s{i}" for i in range(SIGNATURE)]


def by_rare_words(open_texts: DataFrame) -> DataFrame:
    """id, key of the rarest labelled words of id, text, with the text's signature in ``signs()``."""
    label = F.explode(F.pandas_udf(labels_of, "array<long>")("text")).alias("key")
    counts = open_texts.select(label).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    known = np.array([r.key for r in reversed(top)], np.int64).view(np.uint64)

    def facts(texts: pd.Series) -> pd.DataFrame:
        labels = texts.map(word_labels)
        marks = np.array([signature(x) for x in labels], np.int64).reshape(-1, SIGNATURE)
        return pd.DataFrame({"keys": labels.map(lambda x: rarest(known, x)), **dict(zip(signs(), marks.T))})

    kind = ", ".join(["keys array<long>", *[f"{s} long" for s in signs()]])
    return open_texts.select("id", F.pandas_udf(facts, kind)("text").alias("f")).select("id", F.explode("f.keys").alias("key"), *[F.col(f"f.{s}") for s in signs()])


def remaining(shared: DataFrame, unique: DataFrame, state: DataFrame, tried: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """All pairs that share a sketch and are in different classes of ``state`` (and more: a text meets all members of a class in which one
    shares a key with it), those in small classes as a, b, n without pairs of ``tried`` and those whose lengths or profiles rule the
    similarity out, those in large ones as links a, b (or None), of ``with_members``."""
    member = shared.select("id", "words", "key").join(state, "id")
    several = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    member = written(sized(written(member.join(several, "key", "left_semi"), "open")), "sized")
    few, many = member.filter(F.col("outsiders") <= OUTSIDERS), member.filter(F.col("outsiders") > OUTSIDERS)
    asked = touched(few)
    if many.limit(1).count():
        crowded = written(many.select("id", "words", "root").distinct(), "crowded")
        # written, as its words are counted and then chosen from, and tasks get about as many bytes of it each
        rare = by_rare_words(written(texts_of(base, crowded.select("id"), unique), "crowded_texts"))
        member = written(rare.join(crowded, "id").select("id", "words", "root", "key", *signs()), "rare")
        asked = asked.union(touched(written(sized(member).filter("outsiders > 0"), "rare_sized"), RARE, signs())).distinct()
    pairs, links = with_members(written(asked, "asked"), state, unique, base)
    return pairs.join(tried, ["a", "b"], "left_anti"), links


def apart(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """The pairs in different classes, with these as ra and rb."""
    ra, rb = state.select(F.col("id").alias("a"), F.col("root").alias("ra")), state.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    return pairs.join(ra, "a").join(rb, "b").filter("ra <> rb")


def merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` (id, root) after the classes at both ends of every link became one."""
    ends, n = counted(apart(links, state).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "ends", F.lit(True))
    if not n:
        return state
    roots = components(ends).select(F.col("id").alias("root"), F.col("root").alias("above"))
    return written(state.join(roots, "root", "left").select("id", F.coalesce("above", "root").alias("root")), "state")


def settled(state: DataFrame, pairs: DataFrame, texts: DataFrame, first: int = FIRST_ROUND, links: DataFrame | None = None) -> DataFrame:
    """``state`` after ``links`` and all ``pairs`` (a, b, n) are verified or in one class: first a few of each text, those that share most
    sketches, so that classes grow before the many are looked at."""
    place = F.row_number().over(W.partitionBy("b").orderBy(F.desc("n"), "a"))
    pairs = written(pairs.select("a", "b", place.alias("place")), "placed")
    for which in (F.col("place") <= first, F.col("place") > first):
        found = verified(apart(pairs.filter(which), state), texts)
        state = merged(state, written(found if links is None else found.union(links), "more"))
        links = None
    return state


def texts_of(base: DataFrame, ids: DataFrame, unique: DataFrame) -> DataFrame:
    """id and text of every id in ``ids`` (once each), found by a row that has it. Few ids go to the texts; many make both sides meet."""
    wanted = written(unique.join(ids, "id", "left_semi").select(F.col("id").alias("node"), F.col("doc").alias("id"), "raw"), "wanted")
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    found = base.withColumn("raw", F.xxhash64("text")).join(wanted, ["id", "raw"])
    return found.groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def same_id(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links a, b between the texts of ids that repeat with different texts."""
    several = known.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("id", "low")
    several = known.select("id", "digest").distinct().join(several, "id").filter("digest <> low")
    a, b = nodes.select(F.col("digest").alias("low"), F.col("node").alias("a")), nodes.select("digest", F.col("node").alias("b"))
    return several.join(a, "low").join(b, "digest").select("a", "b").distinct()


def numbered(firsts: DataFrame) -> DataFrame:
    """digest, first and node: a number of its own for every digest, which is its first id; where several texts have that id the others are
    numbered below the smallest id."""
    own = firsts.groupBy("first").agg(F.min("digest").alias("digest"), F.count("*").alias("texts"))
    one = firsts.join(own.select("first", F.col("digest").alias("owner"), "texts"), "first")
    rest = one.filter("digest <> owner").select("digest", "first", F.monotonically_increasing_id().alias("m"))
    least = F.broadcast(firsts.agg(F.min("first").alias("least")))  # one row
    return one.filter("digest = owner").select("digest", "first", F.col("first").cast("long").alias("node")).unionByName(
        rest.join(least).select("digest", "first", (F.col("least") - 1 - F.col("m")).cast("long").alias("node")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (smallest id of the class) and is_first (the row's id is the class's) of every row. Classes are found among different
    texts; copies take part by their digest at the end, so that their number makes no links."""
    with arrow_rows(docs.sparkSession):
        return found_classes(docs, id_col, text_col)


def found_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``classes``: all that needs Python is written before this returns."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    raw = F.xxhash64("text").alias("raw")  # tells the texts of one id apart
    marked = written(base.select("id", raw, F.pandas_udf(sketched, SKETCHED)("text").alias("s")).select("id", "raw", "s.*"), "sketches")
    rows = written(marked.select("id", "digest"), "digests")
    known = marked.filter("digest is not null and id is not null")
    nodes = written(numbered(written(known.groupBy("digest").agg(F.min("id").alias("first")), "firsts")), "nodes")
    unique = known.join(nodes, "digest").filter("id = first").select(
        F.col("node").alias("id"), F.col("first").alias("doc"), "raw", "words", "profile", "sketches")
    unique = written(unique.dropDuplicates(["id"]), "unique")
    forget(marked)  # the sketches of all rows; those of different texts are in unique
    shared = written(buckets(unique), "buckets")
    state = merged(unique.select("id", F.col("id").alias("root")), same_id(rows.filter("digest is not null and id is not null"), nodes))
    best = written(profiled(foremost(stars(shared)), unique), "best")
    state = merged(state, written(verified(apart(best, state), written(texts_of(base, ends_of(best), unique), "texts")), "more"))
    # in a group of near copies a text shares buckets with as many smallest and largest ids as it has sketches: most are in its class by now
    tried = best.select("a", "b")
    pairs = written(candidates(still_open(shared, state), unique, tried), "pairs")
    state = settled(state, pairs, written(texts_of(base, ends_of(pairs), unique), "texts"))
    rest, links = remaining(shared, unique, state, tried.union(pairs.select("a", "b")), base)
    rest = written(rest, "rest")
    state = settled(state, rest, written(texts_of(base, ends_of(rest), unique), "texts"), links=links)
    of_node = nodes.join(state.select(F.col("id").alias("node"), "root"), "node")
    firsts = of_node.groupBy("root").agg(F.min("first").alias("class"))
    of_text = of_node.join(firsts, "root").select("digest", "class")
    out = rows.join(of_text, "digest", "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.col("id").eqNullSafe(class_id).alias("is_first"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the row of its smallest id (of repeated rows with that id, one). Rows with a null id all stay."""
    later = classes(docs, id_col, text_col).filter("not is_first").select(id_col).distinct()
    kept = docs.filter(F.col(id_col).isNotNull()).join(later, id_col, "left_anti").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
