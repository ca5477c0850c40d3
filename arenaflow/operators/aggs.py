"""Aggregates: three medians, percentile cut-offs, floors, shares, zero-filled calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.operators.windows import running_sum


def upper_median(x) -> Column:
    """sorted(v)[n // 2] of a bounded group."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))


def exact_median(x) -> Column:
    return F.percentile(x, 0.5)


def exact_mean(x: str) -> Column:
    """The mean of a numeric column, the same in whatever order the rows are added: six decimals and what is left of them are summed as decimals; only what fits
    into none (infinite, above 1e22) is summed as it comes."""
    value = F.col(x).cast("double")
    main = value.try_cast("decimal(28,6)")
    left = value - main.cast("double")
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    return F.try_divide(total(main) + total(left.cast("decimal(38,30)")) + total(F.when(main.isNull(), value)), F.count(x))


def corr_with_floor(x, y, least: int) -> Column:
    """Pearson correlation, null for small groups and for a constant side."""
    return F.when(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()) >= least, F.nanvl(F.corr(x, y), F.lit(None).cast("double")))


def cutoffs(rows: DataFrame, value: str, shares: tuple[float, ...], least: int = 10) -> DataFrame:
    """Population cut-offs: the value at place int(p * n) in ascending order for each share, none if there are too few rows. Distinct
    values are counted first, so that only they are ordered, and ties need no order."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("n"))
    below = running_sum(counts, value, [], F.col("k"), "upto")
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.floor(F.lit(p) * F.col("n")).alias("place")) for p in shares]))
    places = total.filter(F.col("n") >= least).select(wanted.alias("w")).select("w.*")
    return below.join(F.broadcast(places), (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("k"))).select("share", F.col(value).alias("cutoff"))


def share_of_total(keys: list[str], value: str) -> Column:
    return F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(*keys)))


def zero_filled(counts: DataFrame, day: str, value: str, start: str, end: str, step: str) -> DataFrame:
    """``counts`` (one row a period) on a calendar skeleton, missing periods as 0."""
    spark = counts.sparkSession
    skeleton = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}"))).alias(day))
    return skeleton.join(counts, day, "left").withColumn(value, F.coalesce(value, F.lit(0)))
