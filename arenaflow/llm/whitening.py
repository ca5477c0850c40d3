"""Whitening of embeddings through the distributed SVD of centred rows.

Each component c of a vector becomes the integer x = floor(scale * c) + shift. All vectors that take part are the fit list: their number n
and per-dimension sums S are exact, and the centred row (n * x - S) / n is rounded once. ``RowMatrix.computeSVD`` of the centred rows gives
singular values s and right singular vectors; with divisor n the covariance has eigenvalues e = s * s / n and the same vectors. A row is
whitened by projecting it and dividing by sqrt(e).

The deviation of a row, the sum over dimensions of (n * x - S) ** 2, is an integer and exact: in long arithmetic where the extremes of the
fit list prove that it fits, else in decimals (a deviation that no long holds is null). Total variance comes from these deviations,
trace(V) = sum of deviations / n ** 3, and not from the singular values. The covariance of the whitened rows is measured in a pass of its own by Spark's ``covar_pop``, which centres.

Scale: rows stay distributed; the driver holds sums, extremes, a Gramian of dims x dims (through tree aggregation) and COMPONENTS vectors.

Cases: vectors that are null, or hold null or non-finite components, take no part; vectors of other lengths than the commonest (of equally
common ones the longest) take no part, nor do empty ones; null ids and repeated rows are rows like others; components whose singular value is at most RANK times the largest have no
whitened value and give no row; a table without vectors, or without variance, gives no row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Singular values up to this part of the largest count as zero (a Gramian in doubles tells no smaller ones). Up to so many dimensions all singular values are asked for, which makes MLlib
#: decompose the Gramian directly instead of iterating.
RANK, DIRECT = 1e-7, 1000


def integers(vectors: DataFrame, vec_col: str) -> DataFrame:
    """The vectors that take part as x (array of longs), beside their columns id."""
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return vectors.filter(fine).select("id", x.alias("x"))


def commonest_length(rows: DataFrame) -> int:
    """0 without rows."""
    found = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return found["dims"] if found else 0


def numerators(n: int, sums: list[int], widest: int) -> Column:
    """n * x - S of every dimension, exact; neither n * x nor the result is beyond ``widest``."""
    kind = "long" if widest < 2**62 else "decimal(38,0)"
    at = F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    if kind == "long":
        return F.zip_with("x", at, lambda x, s: F.lit(n).cast("long") * x - s)
    return F.zip_with("x", at, lambda x, s: F.lit(n).cast("decimal(19,0)") * x.cast("decimal(19,0)") - s)


def deviation(n: int, sums: list[int], widest: int) -> Column:
    """Sum of the squares of ``numerators`` as a decimal, null beyond 38 digits."""
    kind = "long" if widest * widest * len(sums) < 2**63 else "decimal(38,0)"
    squares = F.transform(numerators(n, sums, widest), lambda c: F.try_multiply(c, c).cast(kind))
    return F.aggregate(squares, F.lit(0).cast(kind), lambda a, b: F.try_add(a, b).cast(kind)).cast("decimal(38,0)")


def fitted(rows: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """n, S and a bound of all n * |x| and |n * x - S|: exact, from one pass."""
    x = F.col("x")
    one = rows.agg(
        F.count("*").alias("n"), F.array(*[F.sum(x[i].cast("decimal(19,0)")).cast("decimal(38,0)") for i in range(dims)]).alias("s"),
        F.array(*[F.min(x[i]) for i in range(dims)]).alias("low"), F.array(*[F.max(x[i]) for i in range(dims)]).alias("high"),
    ).first()
    n, sums = one["n"], [int(s) for s in one["s"]]
    extremes = list(zip(one["low"], one["high"], sums))
    return n, sums, max(max(n * abs(lo), n * abs(hi), abs(n * lo - s), abs(n * hi - s)) for lo, hi, s in extremes)


def directions(centred: DataFrame, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) of the covariance with divisor n, and their unit vectors as columns; ``centred`` has c, arrays of doubles."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("c").alias("v")), "v")
    found = RowMatrix(rows, n, dims).computeSVD(dims if dims <= DIRECT else min(COMPONENTS, dims), rCond=RANK)
    singular = found.s.toArray()[:COMPONENTS]
    return singular**2 / n, found.V.toArray()[:, : len(singular)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n, deviation, whitened (array, one entry a component), and the arrays explained and the value identity_error, the same in all rows."""
    rows = integers(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v")
    empty = rows.select("id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("deviation"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double"))]).limit(0)
    dims = commonest_length(rows)
    if not dims:
        return empty
    rows = rows.filter(F.size("x") == dims)
    n, sums, widest = fitted(rows, dims)
    total = rows.agg(F.sum(deviation(n, sums, widest)).cast("decimal(38,0)").alias("t")).first()["t"]
    if not total:
        return empty
    exact = deviation(n, sums, widest)
    centred = rows.select("id", exact.try_cast("long").alias("deviation"), F.transform(numerators(n, sums, widest), lambda c: c.cast("double") / n).alias("c"))
    values, unit = directions(centred, n, dims)
    weights = unit / np.sqrt(values)

    @F.pandas_udf("array<double>")
    def projected(c: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(c.to_list()) @ weights)) if len(c) else pd.Series([], dtype=object)

    out = centred.select("id", "deviation", projected("c").alias("whitened"))
    k = len(values)
    w = [F.col("whitened")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    measured = out.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(measured[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    trace = int(total) / n**3  # a quotient of whole numbers, rounded once
    explained = F.array(*[F.lit(float(e) / trace) for e in values])
    return out.select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))


def whitened_entries(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``whiten`` with a row for each component (from 1)."""
    out = whiten(vectors, id_col, vec_col)
    each = out.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "e"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"),
        F.col("e.explained").alias("explained"), "identity_error")
