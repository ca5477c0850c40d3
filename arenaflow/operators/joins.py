"""Join shapes that the analytics need beside plain equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parts(rows: DataFrame, each: int = 50_000) -> int:
    """So many partitions that one has about ``each`` of ``rows``, however large the input, and no fewer than the session's."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def by_match(rows: DataFrame, match: str) -> DataFrame:
    """``rows`` dealt by match in ``parts``. What is then grouped or joined by keys that hold the match needs no other shuffle."""
    return rows.repartition(parts(rows), match)


def unordered_pairs(rows: DataFrame, match: str, member: str, values: list[str]) -> DataFrame:
    """Pairs a < b of a match's members; ``rows`` must hold one row for each match and member (aggregate first). A match has few
    members, so the pairs of a match are bounded."""
    a, b = (rows.select(match, *[F.col(x).alias(f"{x}_{s}") for x in (member, *values)]) for s in "ab")
    return a.join(b, match).filter(F.col(f"{member}_a") < F.col(f"{member}_b"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, at: str, bucket: float) -> DataFrame:
    """Rows of ``right`` with start <= at <= end of a row of ``left`` with equal keys. Intervals go to every bucket that they touch,
    so the join is an equi join and a hot key spreads over its buckets."""
    left = left.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    right = right.withColumn("__b", F.floor(F.col(at) / bucket))
    return left.join(right, [*keys, "__b"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__b")


def asof_next(rows: DataFrame, keys: list[str], at: str, hit: Column, values: list[str], tie: str) -> DataFrame:
    """For each row the next later row of the same keys for which ``hit`` holds, as columns next_*; one sort, no join. Rows are read from
    the last to the first, so that a key's frame only grows and costs as much as its rows."""
    w = W.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)).rowsBetween(W.unboundedPreceding, -1)
    found = F.last(F.when(hit, F.struct(at, *values)), ignorenulls=True).over(w)
    return rows.withColumn("__n", found).select("*", *[F.col(f"__n.{x}").alias(f"next_{x}") for x in (at, *values)]).drop("__n")


def nearest_in_set(points: DataFrame, centres: DataFrame, id_cols: list[str], distance: Column, label: str, most: int = 10_000) -> DataFrame:
    """Nearest of a bounded set for every point. The set's size is checked before it is broadcast; a larger one is refused, as the
    product of two large sides needs another operator."""
    n = centres.count()
    if n > most:
        raise ValueError(f"{n} centres; at most {most} can be compared with every point")
    return points.join(F.broadcast(centres)).groupBy(*id_cols).agg(F.min_by(label, F.struct(distance, label)).alias(label), F.min(distance).alias("distance"))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Row i of each key's sequence beside row i of the other's, numbered from 1; the shorter one ends the zip. Columns of ``order`` are dropped."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    a, b = (side.withColumn(name, place).drop(*order) for side in (left, right))
    return a.join(b, [*keys, name])


def first_match(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def resolve_by_priority(names: DataFrame, known: DataFrame, kinds: list[tuple[Column, Column]], id_col: str, value: str) -> DataFrame:
    """Looks a name up by several keys, best kind first: each kind is an equi join, the smallest kind (then value) wins."""
    found = None
    for k, (mine, theirs) in enumerate(kinds):
        hit = names.select(F.col(id_col), mine.alias("__k")).join(known.select(theirs.alias("__k"), F.col(value)), "__k").select(id_col, F.struct(F.lit(k).alias("kind"), F.col(value)).alias("m"))
        found = hit if found is None else found.union(hit)
    best = found.groupBy(id_col).agg(F.min("m").alias("m"))
    return names.join(best, id_col, "left").select(*names.columns, F.col(f"m.{value}").alias(value), F.col("m.kind").alias("kind"))
