"""Window shapes: ranks, islands, edges, running races, padded top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], at: str, breaks: Column, name: str = "island", tie: str | None = None) -> DataFrame:
    """Numbers runs of rows between breaks; ``breaks`` may use lag over the same keys and order. Rows with equal times come by ``tie``."""
    w = W.partitionBy(*keys).orderBy(*[c for c in (at, tie) if c])
    return rows.withColumn("__b", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn(name, F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def rising_edges(rows: DataFrame, keys: list[str], at: str, condition: Column, tie: str | None = None) -> DataFrame:
    """Times at which a condition becomes true, counted for each key. Rows with equal times come by ``tie``."""
    now = F.coalesce(condition, F.lit(False))
    w = W.partitionBy(*keys).orderBy(*[c for c in (at, tie) if c])
    edge = rows.withColumn("__c", now).withColumn("__e", F.col("__c") & ~F.coalesce(F.lag("__c").over(w), F.lit(False)))
    return edge.groupBy(*keys).agg(F.count_if("__e").alias("edges"))


def time_to_next(rows: DataFrame, keys: list[str], at: Column, order: str, condition: Column, tie: str | None = None) -> Column:
    """Time of the next row (this one included) for which the condition holds; read backwards, so that the frame only grows. Of rows with
    equal times those with a greater ``tie`` come later."""
    return F.min(F.when(condition, at)).over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in (order, tie) if c]).rowsBetween(W.unboundedPreceding, 0))


def first_to(rows: DataFrame, keys: list[str], order: list[str], side: str, target: int) -> DataFrame:
    """Rows of a race up to the one that reaches ``target`` wins: rows that come after the clinch go."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    a = F.coalesce(F.count_if(F.col(side) == 1).over(before), F.lit(0))
    b = F.coalesce(F.count_if(F.col(side) == 0).over(before), F.lit(0))
    return rows.withColumn("wins_a", a).withColumn("wins_b", b).filter((F.col("wins_a") < target) & (F.col("wins_b") < target))


def running_sum(rows: DataFrame, key: str, ties: list[str], add: Column, name: str, parts: int = 64) -> DataFrame:
    """``rows`` with the sum of ``add`` over all rows up to each one in ascending order of a numeric key, then ``ties``. Ranges of the key
    are summed apart and only their totals (``parts`` rows) meet in one place, so no task sorts everything."""
    cuts = sorted(set(rows.agg(F.percentile_approx(F.col(key).cast("double"), [i / parts for i in range(1, parts)], 1000).alias("c")).first().c or []))
    bound = F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>")
    cut = rows.withColumn("__add", add).withColumn("__part", F.size(F.filter(bound, lambda x: x < F.col(key))))
    totals = cut.groupBy("__part").agg(F.sum("__add").alias("__t"))
    before = totals.select("__part", (F.sum("__t").over(W.orderBy("__part")) - F.col("__t")).alias("__before"))
    own = F.sum("__add").over(W.partitionBy("__part").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__add", "__part", "__own", "__before")


def opening_runs(rows: DataFrame, keys: list[str], order: list[str], died: str, measures: list[Column]) -> DataFrame:
    """keys, steps and measures of each key's rows before the first for which ``died`` holds; keys that begin with it have no row."""
    deaths = F.count_if(F.coalesce(F.col(died), F.lit(False))).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__d", deaths).filter("__d = 0").groupBy(*keys).agg(F.count("*").alias("steps"), *measures)


def padded_top(own: DataFrame, pool: DataFrame, key: str, ids: list[str], order: list[Column], n: int) -> DataFrame:
    """The best n rows of each key, filled up from the pool where its own are fewer; rows of the pool that the key has itself (by ``ids``) don't
    come again."""
    pool = pool.join(own.select(key, *ids).distinct(), [key, *ids], "left_anti").select(*pool.columns)
    both = own.withColumn("padded", F.lit(0)).unionByName(pool.withColumn("padded", F.lit(1)))
    return both.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("padded", *order))).filter(F.col("place") <= n)


def conditional_rank(rows: DataFrame, key: str, ties: list[str], unranked: Column, name: str = "place") -> DataFrame:
    """Numbers only the rows that may be ranked, in ascending order of a numeric key; null for the others."""
    summed = running_sum(rows, key, ties, F.when(~unranked, 1).otherwise(0), name)
    return summed.withColumn(name, F.when(~unranked, F.col(name)))


def top_each(rows: DataFrame, stats: dict[str, str], id_col: str, n: int) -> DataFrame:
    """The best n of every statistic: one unpivot, nulls dropped, the direction by statistic (asc or desc)."""
    long = rows.select(id_col, *[F.col(s).cast("double").alias(s) for s in stats]).unpivot([id_col], list(stats), "stat", "value").filter("value is not null")
    sign = F.when(F.col("stat").isin([s for s, d in stats.items() if d == "asc"]), F.col("value")).otherwise(-F.col("value"))
    return long.withColumn("place", F.row_number().over(W.partitionBy("stat").orderBy(sign, id_col))).filter(F.col("place") <= n)
