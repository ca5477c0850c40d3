"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

One pass computes a fixed number of statistics of each whole text and writes them (some 20 numbers a document). The labelled documents
that may be learned from are split by crc32(id) mod 5: remainders 1 to 3 fit the ridge weights, remainder 4 the calibration,
remainder 0 is held out. Every partition sums its part of the normal equations; the sums of a row of the matrix over all partitions
meet in one group, so the driver gets a matrix of fixed size. The calibration counts labels in a fixed grid of scores and pools
adjacent violators over the grid.

Cases: null and blank texts have all-zero statistics and a score as any other; labels that are null are not learned from; with no
labels of one kind the score is the share of label 1 (0.5 without labels); several labels of a document all count; a null id is
never learned from nor held out; label, language, source and id are no inputs of the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.common import arrow_rows, text_or_empty, written

#: Names of the statistics, in order.
STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digit", "space", "comma_stop", "bang", "bar", "symbol", "other",
    "upper_words", "distinct_words", "top_word", "distinct_pairs", "line_length", "distinct_lines", "end_symbols", "repeated_chars",
)
#: Fixed parameters of the features and the fit.
FEATURES, BANDWIDTH, RIDGE, SEED, GRID = 256, 3.0, 1.0, 20240101, 1000
WORD = re.compile(r"\S+")

# classes of the first 128 code points: 1 upper, 2 digit, 3 blank, 4 comma or stop, 5 exclamation, 6 bar, 7 other symbol, 0 letter
CLASSES = np.zeros(128, np.uint8)
for _c in range(128):
    _s = chr(_c)
    CLASSES[_c] = 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s.isspace() else 4 if _s in ",.;:" else 5 if _s in "!?" else 6 if _s == "|" else 0 if _s.isalpha() else 7


def statistics(text: str) -> list[float]:
    """The numbers named in STATISTICS; all zero for a blank text."""
    words = WORD.findall(text)
    if not words:
        return [0.0] * len(STATISTICS)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, m = len(points), len(words)
    ascii_points = points[points < 128]
    kind = np.bincount(CLASSES[ascii_points], minlength=8)
    sizes = np.fromiter(map(len, words), np.int32, m)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) / (m - 1) if m > 1 else 1.0
    upper_words = sum(n for w, n in counts.items() if w.isupper() and len(w) > 1)
    end_symbols = sum(n for w, n in counts.items() if not w[-1].isalnum() and w[-1] not in ",.;:")
    return [
        np.log1p(n), np.log1p(m), sizes.mean(), (sizes > 14).mean(), *(kind[1:8] / n), (n - len(ascii_points)) / n,
        upper_words / m, len(counts) / m ** 0.9, max(counts.values()) / m, pairs,
        np.log1p(m / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), end_symbols / m,
        (points[1:] == points[:-1]).mean() if n > 1 else 0.0,
    ]


def statistics_of(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def frequencies(dims: int, features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases of cosines whose products approximate a Gaussian kernel."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, 1.0 / BANDWIDTH, (dims, features)), rng.uniform(0, 2 * np.pi, features)


class Model:
    """Everything of fixed size that a score needs."""

    def __init__(self, mean, scale, weights, grid):
        self.mean, self.scale, self.weights, self.grid = mean, scale, weights, grid
        self.directions, self.phases = frequencies(len(mean))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.grid[cell(self.raw(x))]


def cell(raw: np.ndarray) -> np.ndarray:
    """Place in the calibration grid, which spans raw scores from -0.5 to 1.5."""
    return np.clip(((raw + 0.5) / 2.0 * GRID).astype(int), 0, GRID - 1)


def pooled(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic fit: a non-decreasing share for each cell, empty cells as the nearest lower one (or the first)."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total):
        blocks.append([float(good[i]), float(total[i]), int(i)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, t, _ = blocks.pop()
            blocks[-1][0] += g
            blocks[-1][1] += t
    out = np.full(len(total), np.nan)
    for g, t, i in blocks:
        out[i] = g / t
    return pd.Series(out).ffill().bfill().to_numpy()


def gram(stats: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over all rows of (stats, quality); one group for each row of the matrix."""
    size = FEATURES + 1

    def partial(batches):
        a = np.zeros((size, size + 1))
        rows = 0
        for b in batches:
            if len(b):
                f = model.features(np.array(b["stats"].tolist()))
                a += f.T @ np.hstack([f, b["quality"].to_numpy(float)[:, None]])
                rows += len(b)
        if rows:
            yield pd.DataFrame({"i": np.arange(size), "sums": list(a)})

    def total(key, pdf):
        return pd.DataFrame({"i": [key[0]], "sums": [np.sum(pdf["sums"].to_list(), axis=0)]})

    parts = stats.mapInPandas(partial, "i int, sums array<double>")
    a = np.zeros((size, size + 1))
    for r in parts.groupBy("i").applyInPandas(total, "i int, sums array<double>").collect():
        a[r.i] = r.sums
    return a[:, :-1], a[:, -1]


def fit(learn: DataFrame, calibrate: DataFrame) -> Model:
    """A model of rows (stats, quality)."""
    dims = len(STATISTICS)
    x = [F.col("stats")[i] for i in range(dims)]
    head = learn.agg(F.count("*").alias("n"), F.avg("quality").alias("share"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    share = 0.5 if head.share is None else float(head.share)
    flat = Model(np.zeros(dims), np.ones(dims), np.zeros(FEATURES + 1), np.full(GRID, share))
    if share in (0.0, 1.0) or not head.n:
        return flat
    mean = np.array([head[f"m{i}"] for i in range(dims)])
    scale = np.array([max(head[f"s{i}"], 1e-6) for i in range(dims)])
    model = Model(mean, scale, flat.weights, flat.grid)
    a, b = gram(learn, model)
    penalty = np.eye(FEATURES + 1) * RIDGE
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a + penalty, b)

    @F.pandas_udf("int")
    def place(s: pd.Series) -> pd.Series:
        return pd.Series(cell(model.raw(np.array(s.tolist()))))

    good, total = np.zeros(GRID), np.zeros(GRID)
    for r in calibrate.groupBy(place("stats").alias("cell")).agg(F.sum("quality").alias("good"), F.count("*").alias("n")).collect():
        good[r.cell], total[r.cell] = r.good, r.n
    if total.sum():
        model.grid = pooled(good, total)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """id, held_out, score and predicted of every row; ``labels`` has the id and quality (0 or 1)."""
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    with arrow_rows(docs.sparkSession):
        stats = written(docs.select(F.col(id_col), F.pandas_udf(statistics_of, "array<double>")(text_or_empty(text_col)).alias("stats")), "stats")
    known = labels.select(F.col(id_col), F.col("quality").cast("double").alias("quality")).filter(F.col("quality").isin(0.0, 1.0))
    marked = written(stats.filter(fold != 0).join(known, id_col).select("stats", "quality", fold.alias("fold")), "marked")
    model = fit(marked.filter(F.col("fold") < folds - 1), marked.filter(F.col("fold") == folds - 1))

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(s.tolist()))) if len(s) else pd.Series([], dtype=float)

    out = stats.select(id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), score("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that the classifier rejects. The score is a function of the text, so all rows of an id that are kept
    have a score of their own at or above the threshold; with repeated ids the lowest score decides for all of them."""
    scored = score_quality(docs, labels, threshold, id_col)
    bad = scored.filter("predicted = 0").select(id_col).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad[id_col]), "left_anti")
