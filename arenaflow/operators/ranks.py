"""Exact ranks and order statistics inside groups of any size.

Equal values are counted first, so that a value that many rows share is one row. A group with more than ALONE different values is cut
into ranges of the value; ranges are summed apart and their totals (a few rows a group) are summed over the ranges before. So no task
holds a whole large group, and nothing is collected into an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Different values up to which a group is one range; ranges of a group at most.
ALONE, MOST_RANGES = 100_000, 10_000


def counted_upto(rows: DataFrame, keys: list[str], value: str, alone: int = ALONE, weight: Column | None = None) -> DataFrame:
    """keys, value, k (rows that have it), upto (rows of the group with at most this value) and n (rows of the group), one row for every different value;
    null values are left out. ``value`` is numeric. With ``weight``, rows count as much as that says."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("k"))
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("__m"), F.sum("k").alias("n"))
    largest = sizes.agg(F.max("__m").alias("m")).first()["m"] or 0
    if largest <= alone:
        w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        return counts.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(W.partitionBy(*keys)))
    ranges = min(MOST_RANGES, -(-largest // alone) + 1)
    large = joined(counts, sizes.filter(F.col("__m") > alone).drop("n"), keys, "left_semi")
    cuts = large.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges).alias("__cuts"))
    both = joined(counts, cuts, keys, "left")
    cut = both.withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))).drop("__cuts")
    totals = cut.groupBy(*keys, "__range").agg(F.sum("k").alias("__t"))
    w = W.partitionBy(*keys)
    totals = totals.select(*keys, "__range", (F.sum("__t").over(w.orderBy("__range")) - F.col("__t")).alias("__before"), F.sum("__t").over(w).alias("n"))
    own = F.sum("k").over(W.partitionBy(*keys, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    out = joined(cut.withColumn("__own", own), totals, [*keys, "__range"], "inner")
    return out.select(*keys, value, "k", (F.col("__own") + F.col("__before")).alias("upto"), "n")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null."""
    names = {k: f"__right_{k}" for k in keys}
    right = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in names])
    on = F.lit(True)
    for k, n in names.items():
        on = on & left[k].eqNullSafe(right[n])
    return left.join(right, on, how).drop(*names.values())


def ranked(rows: DataFrame, keys: list[str], value: str, name: str = "place", of: str = "of", descending: bool = True, alone: int = ALONE) -> DataFrame:
    """``rows`` with the number of strictly better ones of the group plus 1, and the group's size. Null values come after all others and
    share a place; null keys are a group."""
    table = counted_upto(rows, keys, value, alone)
    better = F.col("n") - F.col("upto") if descending else F.col("upto") - F.col("k")
    places = table.select(*keys, value, (better + 1).alias(name))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias(of), F.count(value).alias("__known"))
    known = joined(rows.filter(F.col(value).isNotNull()), places, [*keys, value], "inner")
    known = joined(known, sizes.drop("__known"), keys, "inner")
    rest = joined(rows.filter(F.col(value).isNull()), sizes, keys, "inner").withColumn(name, F.col("__known") + 1).select(*known.columns)
    return known.unionByName(rest)


def at_places(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]], alone: int = ALONE) -> DataFrame:
    """keys, n (rows with a value) and for each name the value at that place (from 1, a function of n) in ascending order; null where a group has no such place."""
    table = counted_upto(rows, keys, value, alone)
    inside = lambda p: (p > F.col("upto") - F.col("k")) & (p <= F.col("upto"))
    return table.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(inside(at(F.col("n"))), F.col(value))).alias(name) for name, at in places.items()])


def medians(rows: DataFrame, keys: list[str], value: str, alone: int = ALONE) -> DataFrame:
    """keys, n, upper (sorted(v)[n // 2]), lower (of even groups the other middle one) and middle (their mean)."""
    found = at_places(rows, keys, value, {"upper": lambda n: F.floor(n / 2) + 1, "lower": lambda n: F.floor((n + 1) / 2)}, alone)
    return found.withColumn("middle", F.col("lower") + (F.col("upper") - F.col("lower")) / 2)
