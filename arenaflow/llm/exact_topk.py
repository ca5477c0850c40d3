"""Exact top-k inner products by no-random-access aggregation.

Vectors are made of integers floor(scale * x). The candidates of a task (in lots of LISTED components) give a sorted list for every
dimension, which a query reads from the top where its weight is positive and from the bottom where it is negative. All lists are read in
step to doubling depths. What has been read of a candidate, plus the worst (best) values that the unread entries of its other lists can
still take, is its lower (upper) bound; the best possible unread value of a list is the one at the reading position. Candidates whose upper
bound is below the k-th largest lower bound leave the query. A query with few candidates left stops reading and their final scores are
resolved; one that never stops has read its lists to their ends, and then what was read is the score. The bounds of many queries and
candidates are matrix products over the entries read so far. They are made at a depth only if those of a few candidates show that
somebody would leave, which decides when bounds are looked at and not what is returned.

Each lot keeps k rows a query, and a window over those gives the result, as the best k of all are among the best k of their lots.

Queries are a stated set; they are taken in blocks of ``block`` rows of a range of ids. A block is collected, sent to the tasks and its
result written before the next one is collected, so that more queries mean more passes and never more in the driver or a task.

On vectors whose scores are the sum of many small parts (random ones) no bound decides before the lists end, and the cost is that of all
products; on skewed ones the lists are read in part. ``read`` of ``top_of_lot`` counts the entries.

Cases: vectors that are null, or hold null or non-finite components, take no part; so do rows with a null id; ties go to the smaller
id; a query's own id is never its candidate; vectors of different lengths only meet those of their own; fewer than k candidates
give fewer rows; scores must fit a long; repeated rows are candidates each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.llm.common import written

RESULT = "query_id long, vec_id long, score long"
#: The first depth is this part of the lists (each next one is twice as deep); queries with at most FEW * k candidates are resolved.
FIRST, FEW = 1 / 32, 4
#: Candidates whose bounds are tried first, and the part of those that must leave for all bounds to be made.
TRIED, LEAVING = 256, 0.2
#: Largest sums of products that doubles and single floats hold exactly.
EXACT, EXACT_SINGLE = float(2**53), float(2**24)
#: Components in one lot of candidates; queries times candidates whose bounds are held at once.
LISTED, CELLS = 4_000_000, 2_000_000


class Lists:
    """The sorted lists of a lot of candidates ``c`` (rows), read in step from both ends."""

    def __init__(self, c: np.ndarray):
        self.n, order = len(c), np.argsort(c, axis=0, kind="stable")
        self.c, self.ascending = c, np.take_along_axis(c, order, 0)
        self.place = np.empty(c.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], 0)

    def bounds(self, q: np.ndarray, columns: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x candidates) of the candidates ``columns`` after ``depth`` entries of every list."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        c, place, last = self.c[columns], self.place[columns], self.n - 1
        read_up, read_down = place >= self.n - depth, place < depth
        lower = up @ np.where(read_up, c, self.ascending[0]).T + down @ np.where(read_down, c, self.ascending[last]).T
        high, low = self.ascending[self.n - depth], self.ascending[depth - 1]  # the values at the reading positions
        upper = up @ np.where(read_up, c, high).T + down @ np.where(read_down, c, low).T
        return lower, upper

    def somebody_leaves(self, q: np.ndarray, alive: np.ndarray, depth: int) -> bool:
        """Whether enough of a few candidates fall below the best lower bound among them."""
        columns = np.unique(np.linspace(0, self.n - 1, TRIED).astype(np.int64))
        lower, upper = self.bounds(q, columns, depth)
        live = alive[:, columns]
        best = np.where(live, lower, -np.inf).max(axis=1)
        return (live & (upper < best[:, None])).sum() >= LEAVING * max(1, live.sum())


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    kept = np.arange(len(scores))
    if len(kept) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(kept) - k)[-k])
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


def top_of_lot(q_ids, q, ids, c, k: int, read: dict | None = None) -> pd.DataFrame:
    """The best k candidates of each query within one lot of candidates, with their scores. ``read`` gets for every query id the number
    of entries that were read, those of resolved candidates included."""
    out, n, m = [], len(c), c.shape[1]
    single = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(m, 1) < EXACT_SINGLE
    q, lists = (q.astype(np.float32), Lists(c.astype(np.float32))) if single else (q, Lists(c))
    step = max(1, CELLS // n)
    for lo in range(0, len(q), step):
        part_ids = q_ids[lo : lo + step]
        alive = part_ids[:, None] != ids[None, :]
        open_queries, depth = np.arange(len(part_ids)), max(k, int(FIRST * n))
        while len(open_queries) and depth < n:
            part = q[lo : lo + step][open_queries]
            if lists.somebody_leaves(part, alive[open_queries], depth):
                columns = np.flatnonzero(alive[open_queries].any(axis=0))
                lower, upper = lists.bounds(part, columns, depth)
                live = alive[np.ix_(open_queries, columns)]
                place = max(0, len(columns) - k)
                kth = np.partition(np.where(live, lower, -np.inf), place, axis=1)[:, place]
                live &= upper >= kth[:, None]
                alive[np.ix_(open_queries, columns)] = live
                done = live.sum(axis=1) <= FEW * k
                for i in open_queries[done]:
                    own = np.flatnonzero(alive[i])
                    scores = lists.c[own] @ q[lo + i]
                    best = own[best_of(scores, ids[own], k)]
                    out.append((part_ids[i], ids[best], scores[np.searchsorted(own, best)]))
                    if read is not None:
                        read[int(part_ids[i])] = depth * m + int(((lists.place[own] >= depth) & (lists.place[own] < n - depth)).sum())
                open_queries = open_queries[~done]
            depth *= 2
        if len(open_queries):
            # the lists have been read to their ends: every entry of the candidates left is known
            columns = np.flatnonzero(alive[open_queries].any(axis=0))
            scores = q[lo : lo + step][open_queries] @ lists.c[columns].T
            for i, row in zip(open_queries, scores):
                own = np.flatnonzero(alive[i, columns])
                best = own[best_of(row[own], ids[columns[own]], k)]
                out.append((part_ids[i], ids[columns[best]], row[best]))
                if read is not None:
                    read[int(part_ids[i])] = n * m
    frames = [pd.DataFrame({"query_id": i, "vec_id": v, "score": s.astype(np.int64)}) for i, v, s in out]
    return pd.concat(frames) if frames else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def exact_by_hand(q_ids, q, ids, c, k: int) -> pd.DataFrame:
    """The same with Python's integers, for values whose products doubles can't hold."""
    rows = []
    for a, x in zip(q_ids.tolist(), q):
        scores = sorted((-sum(int(u) * int(v) for u, v in zip(x, y)), b) for b, y in zip(ids.tolist(), c) if b != a)
        rows += [(a, b, -s) for s, b in scores[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and whole-number components as doubles, of rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Spark's floor gives a long, so huge values stay as they are: a double of 2^53 or more is whole already
    whole_part = lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return vectors.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole_part).alias("v"))


def query_blocks(queries: DataFrame, block: int):
    """Collects the queries in ranges of ids with at most ``block`` rows each (more only where one id repeats)."""
    n = queries.count()
    if not n:
        return
    parts = math.ceil(n / block)
    cuts = queries.agg(F.percentile_approx("vec_id", [i / parts for i in range(1, parts)] or [0.5], 10000).alias("c")).first().c if parts > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    for a, b in zip(edges, edges[1:]):
        rows = queries
        if a is not None:
            rows = rows.filter(F.col("vec_id") > a)
        if b is not None:
            rows = rows.filter(F.col("vec_id") <= b)
        got = rows.collect()
        if got:
            yield got


def lots(batches, sets):
    """(length, ids, components) of a task's candidates in lots of about LISTED components, by length of the vectors."""
    waiting: dict[int, list] = {}
    for b in batches:
        lengths = b["v"].map(len).to_numpy()
        for n in np.unique(lengths).tolist():
            if n not in sets:
                continue
            own = b[lengths == n]
            held = waiting.setdefault(n, [])
            held.append((own["vec_id"].to_numpy(), np.array(own["v"].tolist(), float).reshape(len(own), n)))
            if sum(len(i) for i, _ in held) * max(n, 1) >= LISTED:
                yield n, *map(np.concatenate, zip(*held))
                waiting[n] = []
    for n, held in waiting.items():
        if held:
            yield n, *map(np.concatenate, zip(*held))


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every``, its k best of all other rows."""
    all_rows = usable(vectors, scale, id_col, vec_col)
    result = None
    for got in query_blocks(all_rows.filter(F.col("vec_id") % every == 0), block):
        by_length: dict[int, list] = {}
        for r in got:
            by_length.setdefault(len(r.v), []).append(r)
        sets = {n: (np.array([r.vec_id for r in rs]), np.array([r.v for r in rs], float).reshape(len(rs), n)) for n, rs in by_length.items()}

        def search(batches, sets=sets):
            for n, ids, c in lots(batches, sets):
                q_ids, q = sets[n]
                largest = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(n, 1)
                found = (top_of_lot if largest < EXACT else exact_by_hand)(q_ids, q, ids, c, k)
                yield found.astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

        found = written(all_rows.mapInPandas(search, RESULT), "topk")
        result = found if result is None else result.unionByName(found)
    if result is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
