"""Outputs: JSON documents by key with an index, what has to be written anew, a ledger of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def documents(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and document (JSON of the key and the fields, in this order). ``rows`` has one row for each key."""
    return rows.select(key, F.to_json(F.struct(key, *fields)).alias("document"))


def write_documents(docs: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """Writes ``docs`` (key, document) as JSON lines in folders by a hash of the key, and an index of key, bucket and digest beside them.
    Buckets that a later run doesn't touch stay as they are."""
    placed = docs.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{path}/documents")
    index = placed.select(key, "bucket", F.sha2("document", 256).alias("digest"))
    index.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/index")


def to_write(docs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Documents that are new or differ from the index."""
    known = index.select(key, F.col("digest").alias("__digest"))
    return docs.join(known, key, "left").filter(~F.col("__digest").eqNullSafe(F.sha2("document", 256))).drop("__digest")


def changed_or_new(cohort: DataFrame, matches: DataFrame, done: DataFrame, key: str, since: Column) -> DataFrame:
    """Keys of the cohort with a match after ``since`` (``matches``: key, played_at) or without a document so far."""
    changed = matches.filter(F.col("played_at") > since).select(key)
    new = cohort.select(key).join(done.select(key), key, "left_anti")
    return cohort.select(key).join(changed, key, "left_semi").union(new).distinct()


def with_deltas(runs: DataFrame, label: str, order: str, values: list[str]) -> DataFrame:
    """A ledger of runs with the change of each value since the label's run before (null for its first)."""
    w = W.partitionBy(label).orderBy(order)
    return runs.select("*", *[(F.col(v) - F.lag(v).over(w)).alias(f"{v}_delta") for v in values])


def board_documents(boards: DataFrame) -> DataFrame:
    """stat and document (JSON of its entries by place) of ``profiles.leaderboards``: a board has a few entries."""
    entry = F.struct("place", "canonical_id", "value", "formatted")
    top = boards.groupBy("stat").agg(F.sort_array(F.collect_list(entry)).alias("top"))
    return top.select("stat", F.to_json(F.struct("stat", "top")).alias("document"))


def lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects, nulls written out, one a line."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def copy_lines(rows: DataFrame) -> DataFrame:
    """Rows in the text form of bulk copies: fields parted by tabs, nulls as \\N, back slashes, tabs and line breaks escaped."""

    def field(c: str) -> Column:
        text = F.col(c).cast("string")
        for sign, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(sign), F.lit(escaped))
        return F.coalesce(text, F.lit("\\N"))

    return rows.select(F.concat_ws("\t", *[field(c) for c in rows.columns]).alias("value"))


def from_copy_lines(text: DataFrame, schema: str) -> DataFrame:
    """Rows of ``copy_lines`` (value) with the types of a schema; a field that doesn't fit is null."""
    kinds = text.sparkSession.createDataFrame([], schema).schema
    parts = text.select(F.split("value", "\t", -1).alias("f"))
    # a mark that no field holds stands for an escaped back slash meanwhile
    mark = "\u0000"

    def field(i: int) -> Column:
        raw = F.get("f", F.lit(i))
        out = F.replace(raw, F.lit("\\\\"), F.lit(mark))
        for sign, escaped in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\\", mark)):
            out = F.replace(out, F.lit(escaped), F.lit(sign))
        return F.when(raw != "\\N", out)

    return parts.select(*[field(i).try_cast(k.dataType).alias(k.name) for i, k in enumerate(kinds)])
