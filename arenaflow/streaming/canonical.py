"""Names of a stream get identities as they come: only names that have none are resolved, and a batch counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arenaflow.functions import names as N
from arenaflow.operators import aliases, identity

MAP = "raw_name string, canonical_id string, source string, score double, batch long"


def own_id(raw_name: str | Column) -> Column:
    """The id that a name without a known identity mints. It depends on the name alone: the slug where that says all of the normal form, else
    with a part of the form's digest, so that names that are written differently never share an id by chance of order."""
    form = N.normalised(raw_name)
    slug = F.regexp_replace(F.regexp_replace(form, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    base = F.when(slug == "", "player").otherwise(slug)
    exact = F.when(form == "", F.sha2(raw_name, 256)).otherwise(F.sha2(form, 256))
    return F.when((slug == form) & (form != ""), slug).otherwise(F.concat_ws("-", base, F.substring(exact, 1, 8)))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The name map, empty if nothing was written yet."""
    try:
        return spark.read.schema(MAP).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MAP)


def resolver(path: str, known: Callable[[SparkSession], DataFrame], excludes: Callable[[SparkSession], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for rows of player_name and player_login. Names without an entry in the map of the batches before get one: resolved
    against ``known`` (canonical_id, variant), which batches don't change, else an id of their own. Each batch writes a folder of its
    own, so that one that runs again replaces what it wrote. Any split of the names gives the same map, if it doesn't tear the logins of one name
    apart (a name keeps what it was resolved to when it first came)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_map(spark, path).filter(F.col("batch") < number).select(F.col("raw_name").alias("player_name"))
        fresh = batch.filter("player_name is not null").select("player_name", "player_login").join(before, "player_name", "left_anti")
        fresh = aliases.first_of_name(fresh).select(F.col("player_name").alias("raw_name"), F.nullif("player_login", F.lit("")).alias("login"))
        found = identity.resolve(fresh, known(spark), excludes(spark) if excludes else None)
        sure = F.col("how").isin("login", "exact", "fuzzy")
        rows = found.select(
            "raw_name", F.when(sure, F.col("canonical_id")).otherwise(own_id("raw_name")).alias("canonical_id"), F.col("how").alias("source"), "score")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def assigned(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts without an identity get that of their name; the others keep theirs."""
    found = names.select(F.col("raw_name").alias("player_name"), F.col("canonical_id").alias("__id"))
    return facts.join(found, "player_name", "left").withColumn("canonical_id", F.coalesce("canonical_id", "__id")).select(*facts.columns)
