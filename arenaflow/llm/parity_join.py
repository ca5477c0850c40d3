"""Jaccard self join of word n-gram sets by parity sketches.

A document is the set of its distinct runs of three words (words split at ASCII white space, A-Z in lower case; fewer words make one run). Two
link when their sets' Jaccard similarity is at least 0.9, that is, when the symmetric difference is at most (a + b) / 19 for sets of a and b runs.

Every run is hashed to one bit of a sketch and flips it (XOR). What two sets share cancels, so the Hamming distance of two sketches never
exceeds the symmetric difference. A sketch made for a size band, whose largest pairs may differ in D runs, has P = D + 1 + S words of 64 bits, its parts: D
flips spoil at most D parts, so S + 1 parts at least are equal in both sketches (pigeonhole). Parts with fewer than STRONG bits set
are weak: they say little and would crowd. A document emits the strong parts of a sketch as join keys, and those of further
sketches with other hash functions until one has at most S weak parts. A pair that may link then shares a strong part: where the first of
the two stops, at most S of the S + 1 equal parts are weak, and the other emitted that sketch too. A document emits for the band of its size
and for the next if partners can be that large; the band is that of the larger set. Nothing is lost by chance: hashes decide how many candidates
there are, never which links are found.

Equal sets join by digest before all this, so copies make no candidates. Sets that share a key meet the smallest of the bucket first (a star,
linear in its size); sketches rule out most pairs, and the rest are verified on the texts. What shares a key and is still in different
classes is compared sketch by sketch, in blocks of about BLOCK sets which hold sets of one neighbourhood: each pair of blocks
that share a key is one group of a cogroup, and only pairs whose Hamming distance allows the link leave it, first the closest one for a set and
class and, after those have merged what they link, all. That part compares (sets of a neighbourhood) squared sketches of some n / 4 bytes, but neither
emits nor verifies those pairs. Classes are the connected components of the verified links.

Runs are told apart by 64-bit hashes: counts and intersections are exact unless two runs of one pair of documents collide (chance about
n * n / 2 ** 64).

Scale: texts are read once for sketches and once for the candidates' texts; a document emits about n / 6 keys of 8 bytes; buckets are reduced by
partial minima and joins that Spark can split, never collected; blocks are bounded in rows and bytes.

Cases: null texts and texts without words have no set (n_shingles 0) and are classes of their own; repeated rows each give a row; an
id that repeats with different texts joins their classes; rows with a null id have a null component and take no part; an empty table gives no row; ids are
integers; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.common import chunks, hashed, text_or_empty, written
from arenaflow.llm.near_dedup import apart, ends_of, merged, mixed, numbered, same_id, texts_of
from arenaflow.shared import forget

RUN = 3
#: Sets link if DIFFERENCE times the symmetric difference is at most the sum of their sizes (Jaccard 0.9).
DIFFERENCE = 19
#: Largest size without partners of other sizes, and the bands' largest sizes above it: each about a quarter larger than the one before.
ALONE = 8
BANDS = [12]
while BANDS[-1] < 2**40:
    BANDS.append(BANDS[-1] * 5 // 4)
#: Bits of a part that is strong; parts that may be weak: one, and one more for so many that may be spoilt.
STRONG, SPARE = 3, 16
#: Bits of the sketch that rules pairs out: the power of two from twice the set's size on, at least LEAST_BITS.
LEAST_BITS = 256
#: Sets and bytes of sketches in a block.
BLOCK, BLOCK_BYTES = 256, 1_000_000
SKETCHED = "digest string, n long, sketch binary, keys array<long>"


def shingles(text: str) -> np.ndarray:
    """The hashes of the distinct runs, sorted. ``bytes`` know no letters and white space but those of ASCII."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return runs_of(hashed(words)) if words else np.empty(0, np.uint64)


def runs_of(words: np.ndarray) -> np.ndarray:
    n = max(1, len(words) - RUN + 1)
    h = words[:n]
    for j in range(1, min(RUN, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return np.unique(mixed(h))


def may_differ(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) // DIFFERENCE


def bands_of(n: int) -> range:
    """The bands in which a set of n runs looks for partners: that of its size and, if partners can be that large, the next."""
    if n <= ALONE:
        return range(0)
    own = int(np.searchsorted(BANDS, n))
    largest = n * (DIFFERENCE + 1) // (DIFFERENCE - 1)  # of a set that it fills to nine tenths
    return range(own, own + 2 if largest > BANDS[own] else own + 1)


def parts(runs: np.ndarray, count: int, band: int, seed: int) -> np.ndarray:
    """The parity sketch of a band as its ``count`` parts of 64 bits."""
    h = runs * np.uint64((band * 4096 + seed + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
    out = np.zeros(count, np.uint64)
    place = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    np.bitwise_xor.at(out, place.astype(np.int64), np.uint64(1) << ((h >> np.uint64(20)) & np.uint64(63)))
    return out


def keys_of(runs: np.ndarray) -> np.ndarray:
    """A hash of every strong part, with its band, sketch and place."""
    out = []
    for band in bands_of(len(runs)):
        spoilt = may_differ(BANDS[band], BANDS[band])
        spare = 1 + spoilt // SPARE
        seed, weak = 0, spare + 1
        while weak > spare:
            words = parts(runs, spoilt + 1 + spare, band, seed)
            strong = np.flatnonzero(np.bitwise_count(words) >= STRONG)
            weak = len(words) - len(strong)
            where = mixed(strong.astype(np.uint64) + np.uint64(((band << 12) + seed << 36) % 2**64))
            out.append(mixed(words[strong] ^ where))
            seed += 1
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def bits_for(n: int) -> int:
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length())


def sketch_of(runs: np.ndarray) -> bytes:
    """The parity sketch that rules pairs out; of a sketch of half as many bits it is the one whose halves XOR to that."""
    bits = bits_for(len(runs))
    out = np.zeros(bits // 64, np.uint64)
    at = runs & np.uint64(bits - 1)
    np.bitwise_xor.at(out, (at & np.uint64(bits // 64 - 1)).astype(np.int64), np.uint64(1) << (at // np.uint64(bits // 64)))
    return out.astype("<u8").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) folded to so many words of 64 bits. Bit k of word j stands for the hash k * words + j, so a half of the words takes each
    second bit of a word and its neighbour at half the distance; XOR of those is the smaller sketch."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        bits = np.unpackbits(np.ascontiguousarray(sketches).view(np.uint8), axis=1, bitorder="little").reshape(len(sketches), 2, half, 64)
        # hash = k * 2 * half + side * half + j keeps the place (2 * k + side) * half + j of 128 * half, taken modulo 64 * half
        place = bits.transpose(0, 2, 3, 1).reshape(len(sketches), half, 128)
        smaller = place[:, :, :64] ^ place[:, :, 64:]
        sketches = np.packbits(smaller, axis=2, bitorder="little").reshape(len(sketches), -1).view("<u8")
    return sketches


def sketched(texts: pd.Series) -> pd.DataFrame:
    """Digest of the set, its size, sketch and keys; nulls for texts without words."""
    values, out = texts.tolist(), []
    for lo, hi in chunks(values):
        words = [t.encode("utf-8", "surrogatepass").lower().split() for t in values[lo:hi]]
        h = hashed([w for ws in words for w in ws])
        ends = np.cumsum([len(ws) for ws in words])
        for ws, end in zip(words, ends):
            if not ws:
                out.append((None, 0, None, None))
                continue
            runs = runs_of(h[end - len(ws) : end])
            out.append((hashlib.md5(runs.astype("<u8").tobytes()).hexdigest(), len(runs), sketch_of(runs), keys_of(runs)))
    return pd.DataFrame(out, columns=["digest", "n", "sketch", "keys"])


def may_link(n_a: pd.Series, a: pd.Series, n_b: pd.Series, b: pd.Series) -> pd.Series:
    """False only for pairs whose sketches differ in more bits than linked sets may differ in runs."""
    out = []
    for n, x, m, y in zip(n_a, a, n_b, b):
        x, y = np.frombuffer(x, "<u8")[None, :], np.frombuffer(y, "<u8")[None, :]
        words = min(x.shape[1], y.shape[1])
        out.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= may_differ(n, m))
    return pd.Series(out, dtype=bool)


def linked(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether the sets of two texts link; the sets of a batch's last texts are kept."""
    known, size, out = {}, 0, []

    def of(text: str) -> np.ndarray:
        nonlocal size
        if text not in known:
            if size > 4_000_000:
                known.clear()
                size = 0
            known[text] = shingles(text)
            size += len(known[text])
        return known[text]

    for x, y in zip(left, right):
        a, b = of(x), of(y)
        total = len(a) + len(b)
        both = total - len(np.union1d(a, b)) if DIFFERENCE * abs(len(a) - len(b)) <= total else 0
        out.append(DIFFERENCE * (total - 2 * both) <= total)
    return pd.Series(out, dtype=bool)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose texts link; ``texts`` has id and text, one row an id."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("left")), texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(F.pandas_udf(linked, "boolean")("left", "right")).select("a", "b")


def star_pairs(shared: DataFrame, unique: DataFrame) -> DataFrame:
    """a, b: each set with the smallest one of its buckets, unless sizes or sketches rule the link out. ``shared`` has key, id and low."""
    pairs = shared.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda c: unique.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(DIFFERENCE * F.abs(F.col("n_a") - F.col("n_b")) <= F.col("n_a") + F.col("n_b"))
    return both.filter(F.pandas_udf(may_link, "boolean")("n_a", "s_a", "n_b", "s_b")).select("a", "b")


def near_in_blocks(every: bool):
    """block, other and the pairs a, b of two blocks (id, root, n, sketch) in different classes whose sketches allow the link: of a set and a class the
    closest, or all."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("block", "other", "a", "b")}, dtype="int64")
        met, out = (left["block"].iat[0], left["other"].iat[0]), []
        sizes = [np.array([len(s) // 8 for s in side["sketch"]], np.int64) for side in (left, right)]
        same = met[0] == met[1]
        for words in sorted(set(sizes[0]) | set(sizes[1])):
            rows = [np.flatnonzero((w == words) | (w == 2 * words)) for w in sizes]
            if not len(rows[0]) or not len(rows[1]):
                continue
            folds = []
            for side, at in zip((left, right), rows):
                folds.append(np.vstack([folded(np.frombuffer(side["sketch"].iat[i], "<u8")[None, :], words) for i in at]))
            (ids, roots, ns), (ids2, roots2, ns2) = ((side["id"].to_numpy()[at], side["root"].to_numpy()[at], side["n"].to_numpy()[at]) for side, at in zip((left, right), rows))
            longer = sizes[1][rows[1]]
            for i in range(len(ids)):
                total = ns2 + ns[i]
                ok = (roots2 != roots[i]) & (DIFFERENCE * np.abs(ns2 - ns[i]) <= total) & (np.minimum(longer, sizes[0][rows[0][i]]) == words)
                if same:
                    ok &= ids2 > ids[i]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                distance = np.bitwise_count(folds[1][at] ^ folds[0][i]).sum(axis=1, dtype=np.int64)
                fits = DIFFERENCE * distance <= total[at]
                at, distance = at[fits], distance[fits]
                if not every and len(at) > 1:
                    order = np.lexsort((distance, roots2[at]))
                    at = at[order[np.r_[True, np.diff(roots2[at][order]) != 0]]]
                out += [(*met, min(ids[i], j), max(ids[i], j)) for j in ids2[at].tolist()]
        return pd.DataFrame(out, columns=["block", "other", "a", "b"], dtype="int64")

    return compare


def blocks(open_ids: DataFrame, shared: DataFrame, unique: DataFrame) -> DataFrame:
    """id, block of the sets of ``open_ids``: sets with the same smallest neighbour are dealt to blocks of about BLOCK sets and BLOCK_BYTES."""
    near = shared.join(open_ids, "id", "left_semi").groupBy("id").agg(F.min("low").alias("near"))
    near = near.join(unique.select("id", F.octet_length("sketch").alias("bytes")), "id")
    deal = near.groupBy("near").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("deals"))
    return near.join(deal, "near").select("id", F.xxhash64("near", F.pmod(F.xxhash64("id"), "deals")).alias("block"))


def still_apart(shared: DataFrame, unique: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (block, id, n, sketch) and pairs of blocks (block, other) for all sets that share a key with a set of another class."""
    member = shared.select("key", "id").join(state, "id")
    crossed = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    member = written(member.join(crossed, "key"), "apart")
    dealt = written(blocks(member.select("id").distinct(), shared, unique), "blocks")
    held = member.join(dealt, "id").groupBy("key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    other = held.select("key", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = held.join(other, "key").filter("block <= other and (low <> high2 or high <> low2)").select("block", "other").distinct()
    return dealt.join(unique.select("id", "n", "sketch"), "id"), pairs


def near_pairs(members: DataFrame, pairs: DataFrame, state: DataFrame, every: bool) -> DataFrame:
    rows, columns = members.join(state, "id"), ["block", "other", "id", "root", "n", "sketch"]
    left = pairs.join(rows, "block").select(*columns)
    # names of its own, as the sides come from the same tables
    right = pairs.join(rows.withColumnRenamed("block", "other"), "other").select(*[F.col(c).alias(c) for c in columns])
    return left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(near_in_blocks(every), "block long, other long, a long, b long")


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links) of every row."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    raw = F.xxhash64("text").alias("raw")  # tells the texts of one id apart
    marked = written(base.select("id", raw, F.pandas_udf(sketched, SKETCHED)("text").alias("s")).select("id", "raw", "s.*"), "sets")
    rows = written(marked.select("id", "n", "digest"), "digests")
    known = marked.filter("digest is not null and id is not null")
    nodes = written(numbered(written(known.groupBy("digest").agg(F.min("id").alias("first")), "firsts")), "nodes")
    unique = known.join(nodes, "digest").filter("id = first").select(F.col("node").alias("id"), F.col("first").alias("doc"), "raw", "n", "sketch", "keys")
    unique = written(unique.dropDuplicates(["id"]), "unique")
    forget(marked)  # the keys of all rows; those of different sets are in unique
    known = rows.filter("digest is not null and id is not null")
    keys = unique.select("id", F.explode("keys").alias("key"))
    lows = keys.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("held")).filter("held > 1").select("key", "low")
    shared = written(keys.join(lows, "key").select("key", "id", "low"), "shared")
    state = merged(unique.select("id", F.col("id").alias("root")), same_id(known, nodes))
    pairs = written(star_pairs(shared, unique), "stars")
    state = merged(state, written(verified(pairs, written(texts_of(base, ends_of(pairs), unique), "texts")), "links"))
    members, met = (written(x, "met") for x in still_apart(shared, unique, state))
    for every in (False, True):
        near = written(near_pairs(members, met, state, every), "near")
        # blocks without such a pair have none later either, as classes only grow together
        pairs, met = written(near.select("a", "b").distinct(), "pairs"), near.select("block", "other").distinct()
        state = merged(state, written(verified(pairs, written(texts_of(base, ends_of(pairs), unique), "texts")), "links"))
    of_node = nodes.join(state.select(F.col("id").alias("node"), "root"), "node")
    firsts = of_node.groupBy("root").agg(F.min("first").alias("component"))
    of_set = of_node.join(firsts, "root").select("digest", "component")
    found = known.join(of_set, "digest").select("id", "n", "component")
    rest = rows.filter("digest is null or id is null").select("id", "n", F.col("id").alias("component"))
    return found.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
