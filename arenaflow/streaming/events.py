"""Streams over events: windows, sessions, repeated delivery, and the rating fold with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from arenaflow.operators import rating

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream, in batches; the folder's log is the high-water mark."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums of closed hours; events that come later than ``late`` are dropped, which the query's progress counts."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events that are delivered again within the watermark count once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def new_keys(path: str, keys: list[str]):
    """A foreachBatch function that appends rows with keys that ``path`` doesn't hold; a batch that runs again appends nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates(keys)
        try:
            old = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            own.write.parquet(path)
            return
        own.join(old.select(*keys), keys, "left_anti").select(*own.columns).write.mode("append").parquet(path)

    return write


class Ratings(StatefulProcessor):
    """Folds the duels of a mode with one state entry for each player; a batch reads and writes the entries of its own players only."""

    def __init__(self, forget_after_days: float | None = None):
        self.ttl = None if forget_after_days is None else int(forget_after_days * 86_400_000)

    def init(self, handle) -> None:
        self.players = handle.getMapState("players", "player long", "mu double, sigma double, last timestamp_ntz", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        duels = rating.in_order(pd.concat(list(rows)))
        ids = sorted({int(p) for c in ("a", "b") for p in duels[c]})
        known = {p: self.players.getValue((p,)) for p in ids if self.players.containsKey((p,))}
        state = {p: (v[0], v[1], None if v[2] is None else pd.Timestamp(v[2])) for p, v in known.items()}
        out, state = rating.fold_rows(duels, state)
        for p, (mu, sigma, last) in state.items():
            self.players.updateValue((int(p),), (float(mu), float(sigma), None if rating.missing(last) else last.to_pydatetime()))
        yield rating.history_frame(out)

    def close(self) -> None:
        pass


def rated(duels: DataFrame, forget_after_days: float | None = None) -> DataFrame:
    """History of a stream of duels; batches in order give what one fold gives. A duel older than a player's last one is rated with what is
    known when it comes. Players that don't play for ``forget_after_days`` of processing time start anew. Needs the state store of RocksDB
    (``spark.sql.streaming.stateStore.providerClass``)."""
    columns = rating.completed(duels)
    return columns.groupBy("mode").transformWithStateInPandas(Ratings(forget_after_days), rating.HISTORY, "Append", "ProcessingTime" if forget_after_days else "None")
