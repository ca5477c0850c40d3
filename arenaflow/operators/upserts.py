"""Merges of a keyed table with new rows. Each returns the new table; null keys never match and are kept as they are."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arenaflow.operators.joins import first_match
from arenaflow.shared import written


def last_wins(new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key of a batch: the first in ``order``."""
    return first_match(new, keys, order)


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of whole rows."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def coalesce_update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert in which a null of the new row keeps the old value."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, on, "full_outer").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def changed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New rows whose values differ from the stored ones (nulls compared as values): what an update has to write."""
    o, n = old.alias("o"), new.alias("n")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    return n.join(o, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]).filter(differs).select("n.*")


def delete(old: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(doomed.select(*keys), keys, "left_anti").select(*old.columns)


def cascade(tables: dict[str, DataFrame], keys: dict[str, str], foreign: list[tuple[str, str, str]], doomed: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables without doomed rows and all that refer to them, and the keys that went. ``keys``: table -> its key column; ``foreign``: (child, column,
    parent), chains and cycles among them; ``doomed``: table -> keys to begin with. Keys of the last round travel along every reference until a round
    finds none; a null reference refers to nothing. Rows of one key go together."""
    gone = {t: written(doomed[t].select(F.col(keys[t]).alias("key")).filter("key is not null").distinct(), "gone") if t in doomed else None for t in tables}
    fresh = {t: g for t, g in gone.items() if g is not None}
    while fresh:
        found: dict[str, DataFrame] = {}
        for child, column, parent in foreign:
            if parent in fresh:
                hit = tables[child].join(fresh[parent].select(F.col("key").alias(column)), column, "left_semi").select(F.col(keys[child]).alias("key"))
                found[child] = hit if child not in found else found[child].union(hit)
        fresh = {}
        for child, hit in found.items():
            new = hit.distinct() if gone[child] is None else hit.distinct().join(gone[child], "key", "left_anti")
            new = written(new, "gone")
            if new.limit(1).count():
                fresh[child] = new
                gone[child] = new if gone[child] is None else gone[child].union(new)
    left = {t: df if gone[t] is None else df.join(gone[t].select(F.col("key").alias(keys[t])), keys[t], "left_anti").select(*df.columns) for t, df in tables.items()}
    return left, {t: g for t, g in gone.items() if g is not None}


def publish(tables: dict[str, DataFrame], root: str, version: str | None = None) -> str:
    """Writes the tables as a version of their own and then makes it the one that ``opened`` reads, in one rename: readers see all tables of
    the old version or all of the new one. A version that is written again replaces what it wrote."""
    spark = next(iter(tables.values())).sparkSession
    version = version or uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/versions/{version}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(root).toUri(), conf)
    draft, current = fs.Path(f"{root}/current-{uuid.uuid4().hex}"), fs.Path(f"{root}/current")
    out = draft.getFileSystem(conf).create(draft)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    context.rename(draft, current, overwrite)
    return version


def opened(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version published last."""
    now = json.loads(spark.read.text(f"{root}/current").first()[0])
    return {name: spark.read.parquet(f"{root}/versions/{now['version']}/{name}") for name in now["tables"]}
