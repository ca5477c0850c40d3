"""Mixing sources to target weights: iterative proportional fitting over source, language and topic.

Texts are read once, for their tokens and the counts of their words in DIMS hashed classes. Topics are learned from the whole corpus: those
vectors are dealt to TOPICS clusters by Lloyd's rounds, in each of which tasks send sums of fixed size. Vectors and
sums are whole numbers, so that topics don't depend on how rows are dealt out.

Tokens are then summed to cells (source, language, topic). Raking multiplies the
cells' weights by target/current for one margin after the other until all margins agree; each is one window over the cells (of many: one
sum and one join). A document's inclusion probability is its cell's weight per token, scaled to the token budget and calibrated where it would
exceed 1; a hash of the id decides, so the sample is the same on every run and does not depend on partitions.

Targets are shares of tokens. ``tempered`` makes them from the corpus: share ** power, scaled to 1. Given targets need not name every
value: those not named share what is left in proportion to their tokens; named values that the corpus lacks are left out and the
rest scaled to 1.

Cases: null source, language or topic are values of their own; null and blank texts have no topic, no tokens and the probability of their
cell (cells without tokens: 0); texts of one content have one topic; a corpus with fewer different texts than TOPICS has as many topics;
repeated rows are decided alike; an empty table gives an empty sample; a budget of all tokens or more takes every row that has tokens and one
of none (or less) takes no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.llm.common import arrow_rows, chunks, counted, hashed, text_or_empty, written

MARGINS = ("source", "lang", "topic")
#: Language targets of the production query; other languages share the rest.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.10}
#: Source and topic shares are tempered by this power.
POWER = 0.7
ROUNDS, TOLERANCE = 30, 1e-6
#: Cells up to which those of one margin value may meet in a task.
FEW = 100_000
#: Clusters, hashed word classes of a vector, Lloyd's rounds, and the whole number that stands for 1 in a vector.
TOPICS, DIMS, LLOYD, UNIT = 8, 64, 6, 10_000


def word_vectors(texts: pd.Series) -> pd.DataFrame:
    """tokens, and vector: the square roots of the counts of words in each class, scaled to length 1, as whole numbers (null without words)."""
    values, out = texts.tolist(), []
    for lo, hi in chunks(values):
        words = [t.split() for t in values[lo:hi]]
        ends = np.cumsum([len(w) for w in words])
        h = hashed([w.lower() for ws in words for w in ws])
        for ws, end in zip(words, ends):
            v = np.sqrt(np.bincount(h[end - len(ws) : end] % np.uint64(DIMS), minlength=DIMS))
            out.append((len(ws), np.rint(v / np.sqrt(len(ws)) * UNIT).astype("<i4").tobytes() if ws else None))
    return pd.DataFrame(out, columns=["tokens", "vector"])


def unpacked(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), DIMS).astype(np.int64)


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, ties to the first; in whole numbers, so that every process finds the same."""
    return ((centres**2).sum(axis=1) - 2 * (v @ centres.T)).argmin(axis=1)


def sums_by_topic(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each centre is nearest to, and the sums of those: a task sends one row a centre and class."""
    k = len(centres)

    def partial(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for b in batches:
            v = unpacked(b["vector"])
            at = nearest(v, centres)
            n += np.bincount(at, minlength=k)
            np.add.at(total, at, v)
        yield pd.DataFrame({"topic": np.repeat(np.arange(k), DIMS), "dim": np.tile(np.arange(DIMS), k), "n": np.repeat(n, DIMS), "total": total.ravel()})

    n, total = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
    rows = vectors.mapInPandas(partial, "topic int, dim int, n long, total long").groupBy("topic", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in rows.collect():
        n[r.topic], total[r.topic, r.dim] = r.n, r.total
    return n, total


def topic_centres(vectors: DataFrame, topics: int = TOPICS, rounds: int = LLOYD) -> np.ndarray:
    """Whole-number centres of the clusters of column vector; the first ones are the different vectors of the smallest hashes."""
    mark = F.xxhash64("vector")
    first = [r.mark for r in vectors.select(mark.alias("mark")).distinct().orderBy("mark").limit(topics).collect()]
    found = vectors.filter(mark.isin(first)).select("vector").distinct().collect() if first else []
    centres = np.array(sorted(unpacked(pd.Series([bytes(r.vector) for r in found])).tolist()), np.int64) if found else np.empty((0, DIMS), np.int64)
    for _ in range(rounds if len(centres) > 1 else 0):
        n, total = sums_by_topic(vectors, centres)
        moved = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres


def with_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> DataFrame:
    """``docs`` with tokens and topic (a cluster's number as a string, null without words) in place of the text; written."""
    read = F.pandas_udf(word_vectors, "tokens long, vector binary")(text_or_empty(text_col))
    with arrow_rows(docs.sparkSession):
        rows = written(docs.withColumn("r", read).select(*[c for c in docs.columns if c != text_col], "r.*"), "vectors")
    centres = topic_centres(rows.filter("vector is not null").select("vector"), topics)

    @F.pandas_udf("int")
    def topic(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype="Int64")
        known = vectors.notna()
        if known.any():
            out[known.to_numpy()] = nearest(unpacked(vectors[known]), centres)
        return out

    return written(rows.withColumn("topic", topic("vector").cast("string")).drop("vector"), "topics")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """margin value and target: share ** power of the margin's tokens, scaled to 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("p", F.pow("t", F.lit(power)))
    total = sums.agg(F.sum("p").alias("p")).first().p or 1.0
    return sums.select(margin, (F.col("p") / total).alias("target"))


def given(cells: DataFrame, margin: str, shares: dict) -> DataFrame:
    """margin value and target from named shares; the rest goes to values without a name by tokens."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).filter("t > 0")
    named = F.lit(None).cast("double")
    for value, share in shares.items():
        named = F.when(F.col(margin) == value, share).otherwise(named)
    sums = sums.withColumn("named", named)
    head = sums.agg(F.coalesce(F.sum("named"), F.lit(0.0)).alias("named"), F.coalesce(F.sum(F.when(F.col("named").isNull(), F.col("t"))), F.lit(0)).alias("free")).first()
    left = max(0.0, 1.0 - sum(shares.values())) if head.free else 0.0
    total = (head.named + left) or 1.0
    free = F.lit(left) * F.col("t") / F.lit(float(head.free or 1))
    return sums.select(margin, (F.coalesce(F.col("named"), free) / total).alias("target"))


def with_margin_sums(state: DataFrame, margin: str, few: bool) -> DataFrame:
    """``state`` with the weight of each row's margin value in column now. Of ``few`` cells those of a value meet; else partial sums do and come
    back by a join, whose result is written, as each later sum reads it twice."""
    if few:
        return state.withColumn("now", F.sum("weight").over(W.partitionBy(margin)))
    sums = state.groupBy(margin).agg(F.sum("weight").alias("now"))
    return written(state.join(sums, state[margin].eqNullSafe(sums[margin])).drop(sums[margin]), "cells")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: int = FEW) -> DataFrame:
    """``cells`` with column weight, whose sums by each margin follow the targets; stops when no factor is off by the tolerance. Up to ``most``
    cells a round is one pass of windows."""
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, t in targets.items():
        state = state.join(t.withColumnRenamed("target", f"to_{margin}"), state[margin].eqNullSafe(t[margin])).drop(t[margin])
    state, n = counted(state, "cells", F.lit(True))
    for _ in range(rounds if n else 0):
        for margin in targets:
            state = with_margin_sums(state, margin, n <= most)
            factor = F.when(F.col("now") > 0, F.col(f"to_{margin}") / F.col("now")).otherwise(0.0)
            state = state.withColumn(f"factor_{margin}", factor).withColumn("weight", F.col("weight") * F.col(f"factor_{margin}")).drop("now")
        # after a whole round the last margin is met; the factors of the round tell how far the others were off
        seen, live = Observation(), lambda m: F.when(F.col("weight") > 0, F.col(f"factor_{m}"))
        state = written(state.observe(seen, *[(F.max(live(m)) / F.min(live(m)) - 1).alias(m) for m in targets]), "cells")
        off = seen.get
        state = state.drop(*[f"factor_{m}" for m in targets])
        if max([off[m] or 0.0 for m in targets]) < tolerance:
            break
    return state.drop(*[f"to_{m}" for m in targets])


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """source, lang, topic, probability: expected tokens are the budget; what cells at probability 1 can't take goes to the others."""
    rate = F.col("weight") / F.col("tokens")
    scale = budget
    for _ in range(20):
        p = F.least(F.lit(1.0), rate * scale)
        head = cells.filter("tokens > 0").agg(
            F.sum(F.when(rate * scale < 1, F.col("tokens") * p)).alias("free"), F.sum(F.when(rate * scale >= 1, F.col("tokens"))).alias("full")
        ).first()
        free, full = head.free or 0.0, head.full or 0.0
        if not free or abs(free + full - budget) <= 1e-9 * budget or budget <= full:
            break
        scale *= (budget - full) / free
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), rate * scale)).otherwise(0.0)
    return cells.select(*MARGINS, p.alias("probability"))


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that the id decides."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, share: float = 0.5, languages: dict = LANGUAGES, power: float = POWER, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, source, lang, topic, tokens, probability and weight (1 / probability) of the sampled rows; ``share``: budget as a share of
    all tokens."""
    short = with_topics(docs.select(F.col(id_col), "source", "lang", F.col(text_col).alias("text")))
    cells = written(short.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    total = cells.agg(F.sum("tokens").alias("t")).first().t or 0
    targets = {"source": tempered(cells, "source", power), "lang": given(cells, "lang", languages), "topic": tempered(cells, "topic", power)}
    rates = written(calibrated(rake(cells, targets), share * total), "rates")
    same = [short[m].eqNullSafe(rates[m]) for m in MARGINS]
    joined = short.join(rates, same, "left").select(short[id_col], *[short[m] for m in MARGINS], "tokens", F.coalesce("probability", F.lit(0.0)).alias("probability"))
    return joined.filter(uniform(id_col, seed) < F.col("probability")).withColumn("weight", 1 / F.col("probability"))
