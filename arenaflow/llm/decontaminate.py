"""Benchmark decontamination with the CGK embedding and bit-sampling LSH over item-sized windows.

Texts are sequences of lower-case words. An item of n words occurs in a document if some stretch of it is within
d = floor((1 - similarity) * n) word edits. CGK walks over a window with one random bit for each (step, word): the bit says whether the
walk advances; the words it sees form a string in which edit distance has become Hamming distance. Each of WALKS walks gives
SAMPLES keys of BITS sampled places; a window whose key equals an item's becomes a candidate, and an exact alignment of the item
against the stretch around the window verifies it.

Only windows that can match are embedded, and no other is lost: with at most d edits one of d + 1 equal pieces of the item is
unchanged, so the words of a piece must stand in the document at a place that fits the window.

The items go to the tasks in blocks of bounded size (``block_chars`` characters), one pass over the documents for each block; a block's
matches are written before the next block is collected. A document never leaves its task and only matches are shuffled.

Cases: null and blank texts match nothing; items without words are ignored; items of fewer than 1 / (1 - similarity) words must occur
exactly; repeated items each give rows; repeated document rows give one row for an id and item, with the best match. Ids may be of any
type that a string can hold; documents with a null id are found as one with the id null, and ``without_leaks`` decides by the text, so that
of rows with a null or repeated id only those that hold an item go.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.common import arrow_rows, chunks, hashed, written

WORD = re.compile(r"\w+")
#: Fixed parameters of the search: walks, keys of each walk, sampled places of each key. See tests/llm for the recall they give.
WALKS, SAMPLES, BITS, SEED = 6, 8, 2, 11
#: Ids pass through the tasks as strings: numbers beside a null would become doubles.
RESULT = "key string, item string, distance int, item_words int, end_word int"
#: Leaked texts (64 bytes each) up to which they are broadcast; more are joined by a shuffle.
SMALL = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mixed(a: np.ndarray, b) -> np.ndarray:
    """A hash of pairs of 64-bit numbers."""
    x = (a ^ (np.asarray(b, np.uint64) + MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words."""
    n = len(h) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, q, np.uint64)
    for j in range(q):
        out = mixed(out, h[j : j + n])
    return out


@lru_cache(maxsize=4096)
def places(length: int) -> np.ndarray:
    """Sampled steps (WALKS, SAMPLES, BITS) of the walk over a window of ``length`` words, which takes two steps a word on average."""
    rng = np.random.default_rng(SEED)
    return np.sort((rng.random((WALKS, SAMPLES, BITS)) * 2 * length).astype(np.int64), axis=2)


def embedded_keys(h: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keys (window, WALKS * SAMPLES) of windows ``h[begin : begin + length]``; past the end of ``h`` or the window stands a pad."""
    keys = np.empty((len(begin), WALKS * SAMPLES), np.uint64)
    source = np.r_[h, np.uint64(0)]
    at = np.stack([places(n) for n in length.tolist()]) if len(length) else np.empty((0, WALKS, SAMPLES, BITS), np.int64)
    end = np.minimum(begin + length, len(h))
    for w in range(WALKS):
        steps = int(at[:, w].max()) + 1
        seen = np.empty((len(begin), steps), np.uint64)
        pos = begin.copy()
        for t in range(steps):
            word = source[np.where(pos < end, pos, len(h))]
            seen[:, t] = word
            bit = (word * np.uint64(2 * (w * 7919 + t) + 1) * MIX) >> np.uint64(63)
            pos += bit.astype(np.int64)
        for s in range(SAMPLES):
            key = mixed(length.astype(np.uint64), w * SAMPLES + s)
            for b in range(BITS):
                key = mixed(key, np.take_along_axis(seen, at[:, w, s, b][:, None], 1)[:, 0])
            keys[:, w * SAMPLES + s] = key
    return keys


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[int, int]]:
    """(edits, last word) of the best place of each item in its text: any start and end in the text are free. All pairs at once."""
    if not items:
        return []
    n, m = np.array([len(i) for i in items]), np.array([len(t) for t in texts])
    a, b = np.zeros((len(items), n.max()), np.uint64), np.ones((len(items), m.max()), np.uint64)
    for k, (i, t) in enumerate(zip(items, texts)):
        a[k, : len(i)], b[k, : len(t)] = i, t
    col = np.arange(m.max() + 1)
    row = np.zeros((len(items), m.max() + 1), np.int32)
    final = row.copy()
    for i in range(n.max()):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i, None] != b))
        row = np.minimum.accumulate(new - col, axis=1) + col
        final[n == i + 1] = row[n == i + 1]
    final[col[None, :] > m[:, None]] = np.iinfo(np.int32).max
    best = final.argmin(axis=1)
    return list(zip(final[np.arange(len(items)), best].tolist(), (best - 1).tolist()))


class Items:
    """Pieces and LSH keys of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        words = [(i, words_of(t or "")) for i, t in rows]
        self.rows = [(i, hashed(w)) for i, w in words if w]
        self.edits = [int((1 - similarity) * len(h) + 1e-9) for _, h in self.rows]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for k, ((_, h), d) in enumerate(zip(self.rows, self.edits)):
            q = len(h) // (d + 1)
            g = grams(h, q)
            pieces.setdefault(q, []).extend((int(g[j * q]), k, j * q) for j in range(d + 1))
        self.pieces = {}
        for q, found in pieces.items():
            found.sort()
            self.pieces[q] = (np.array([f[0] for f in found], np.uint64), np.array([f[1:] for f in found], np.int64))
        keys, owners = [], []
        for k, (_, h) in enumerate(self.rows):
            keys.append(embedded_keys(h, np.array([0]), np.array([len(h)]))[0])
            owners.append(np.full(WALKS * SAMPLES, k))
        flat, own = (np.concatenate(keys), np.concatenate(owners)) if keys else (np.empty(0, np.uint64), np.empty(0, int))
        order = np.argsort(flat, kind="stable")
        self.keys, self.owners = flat[order], own[order]
        self.sets = [set(h.tolist()) for _, h in self.rows]

    def windows(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length) of the windows at which an item may stand; ``doc`` numbers the document of every word."""
        found = []
        for q, (hashes, what) in self.pieces.items():
            g = grams(h, q)
            at = np.flatnonzero(np.isin(g, hashes))
            at = at[doc[at] == doc[at + q - 1]]
            lo, hi = np.searchsorted(hashes, g[at]), np.searchsorted(hashes, g[at], side="right")
            many = hi - lo
            which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            k, offset = what[which].T
            place = np.repeat(at, many) - offset
            d, n = np.array(self.edits, np.int64)[k], np.array([len(h) for _, h in self.rows], np.int64)[k]
            # every shift the edits before the piece can cause
            width = 2 * d + 1
            shift = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) - np.repeat(d, width)
            found.append(np.stack([np.repeat(place, width) + shift, np.repeat(n, width), np.repeat(np.repeat(at, many), width)]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        begin, length, anchor = np.concatenate(found, axis=1)
        first = np.searchsorted(doc, doc[anchor])
        begin = np.maximum(begin, first) if len(begin) else begin
        both = np.unique(np.stack([begin, length]), axis=1)
        return both[0], both[1]

    def matches(self, h: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item number, edits, last word) of verified occurrences."""
        begin, length = self.windows(h, doc)
        cand = set()
        size = max(1, 1_000_000 // (2 * int(length.max(initial=1))))
        for lo in range(0, len(begin), size):
            b, n = begin[lo : lo + size], length[lo : lo + size]
            keys = embedded_keys(h, b, n)
            left, right = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
            for w, s in zip(*np.nonzero(right > left)):
                at = int(b[w])
                for k in self.owners[left[w, s] : right[w, s]]:
                    # windows that overlap are verified together
                    cand.add((int(doc[at]), int(k), at // max(1, int(n[w]))))
        pairs, items, texts, firsts = [], [], [], []
        for d, k, cell in sorted(cand):
            n, e = len(self.rows[k][1]), self.edits[k]
            lo = max(int(starts[d]), cell * n - e)
            hi = min(int(starts[d + 1]), (cell + 2) * n + e)
            span = h[lo:hi]
            if len(self.sets[k] - set(span.tolist())) <= e:
                pairs.append((d, k))
                items.append(self.rows[k][1])
                texts.append(span)
                firsts.append(lo - int(starts[d]))
        out = []
        for lo in range(0, len(items), 256):
            for (d, k), (cost, end), first in zip(pairs[lo : lo + 256], align(items[lo : lo + 256], texts[lo : lo + 256]), firsts[lo : lo + 256]):
                if cost <= self.edits[k]:
                    out.append((d, k, cost, end + first))
        return out


def searcher(items: Items):
    def search(batches):
        for b in batches:
            texts, ids = b["text"].tolist(), b["key"].tolist()
            rows = []
            for lo, hi in chunks(texts):
                words = [words_of(t) for t in texts[lo:hi]]
                sizes = np.array([len(w) for w in words])
                starts = np.r_[0, np.cumsum(sizes)]
                h = hashed([w for ws in words for w in ws])
                if len(h):
                    doc = np.repeat(np.arange(len(words)), sizes)
                    rows += [(ids[lo + d], items.rows[k][0], cost, len(items.rows[k][1]), end) for d, k, cost, end in items.matches(h, doc, starts)]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "item", "distance", "item_words", "end_word"])

    return search


def item_blocks(benchmark: DataFrame, block_chars: int):
    """Items in blocks whose texts have about ``block_chars`` characters, collected one after the other."""
    chars = benchmark.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = chars // block_chars + 1
    for p in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).select(F.col("item_id").cast("string"), "text").collect()
        if rows:
            yield [(r.item_id, r.text) for r in rows]


def matches_of(texts: DataFrame, benchmark: DataFrame, similarity: float, block_chars: int) -> DataFrame:
    """key, item, distance, item_words, end_word of every row of key (string) and text with an item in it."""
    own, out = texts.filter("text is not null"), None
    for rows in item_blocks(benchmark, block_chars):
        with arrow_rows(texts.sparkSession):
            found = written(own.mapInPandas(searcher(Items(rows, similarity)), RESULT), "leaks")
        out = found if out is None else out.unionByName(found)
    return texts.sparkSession.createDataFrame([], RESULT) if out is None else out


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, distance (word edits), item_words, end_word and similarity of every document with an item in it."""
    found = matches_of(docs.select(F.col("doc_id").cast("string").alias("key"), "text"), benchmark, similarity, block_chars)
    best = found.groupBy("key", "item").agg(F.min(F.struct("distance", "item_words", "end_word")).alias("b"))
    return best.select(
        F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("item").cast(benchmark.schema["item_id"].dataType).alias("item_id"), "b.*",
        (1 - F.col("b.distance") / F.col("b.item_words")).alias("similarity"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    of_text = F.sha2("text", 256)
    found = matches_of(docs.select(of_text.alias("key"), "text"), benchmark, similarity, block_chars).select("key").distinct()
    found = written(found, "leaked")
    if found.count() <= SMALL:
        found = F.broadcast(found)
    return docs.join(found, of_text == found["key"], "left_anti")
