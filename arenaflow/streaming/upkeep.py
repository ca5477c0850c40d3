"""Streams that keep things in order: throttled alerts, settled series, snapshots, dead letters, changed documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERTS = "box string, kind string, at timestamp, text string"


def throttled(alerts: DataFrame, minutes: float = 30.0) -> DataFrame:
    """Alerts (box, kind, at, text) of which each box and kind passes one in ``minutes``; the state of a key is the time of the last
    that passed. An alert older than that one is dropped."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "text"])
        passed = []
        for at in rows["at"]:
            now = pd.Timestamp(at).timestamp()
            ok = last is None or now - last >= minutes * 60
            last = now if ok else last
            passed.append(ok)
        state.update((last,))
        yield rows[passed]

    return alerts.groupBy("box", "kind").applyInPandasWithState(run, ALERTS, "last double", "append", GroupStateTimeout.NoTimeout).select("box", "kind", "at", "text")


def settled(games: DataFrame, quiet: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """series, first, last, games of series (rows: series, at) whose last game is more than ``quiet`` past: a session that has closed."""
    s = games.withWatermark("at", late).groupBy("series", F.session_window("at", quiet).alias("w")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("games"))
    return s.select("series", "first", "last", "games")


def by_epoch(path: str, good: str | None = None):
    """A foreachBatch function that writes each batch into a folder of its own, so a batch that runs again replaces itself. With ``good``
    (an SQL condition) other rows go to ``rejected``, and the stream goes on."""

    def write(batch: DataFrame, epoch: int) -> None:
        parts = {"rows": batch} if good is None else {"rows": batch.filter(good), "rejected": batch.filter(f"not coalesce({good}, false)")}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")

    return write


def newest(snapshots: DataFrame, key: str, at: str) -> DataFrame:
    """The last snapshot of each key, with live true only for keys of the newest moment: what isn't in it is no longer live."""
    last = snapshots.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).filter("__r = 1").drop("__r")
    top = snapshots.agg(F.max(at).alias("__top"))  # one row
    return last.join(F.broadcast(top)).withColumn("live", F.col(at) == F.col("__top")).drop("__top")


def unparsed(games: DataFrame, parsed: DataFrame, version: int) -> DataFrame:
    """Games (game_id) that no run of at least this version has parsed: ``parsed`` has game_id and version."""
    return games.join(parsed.filter(F.col("version") >= version).select("game_id"), "game_id", "left_anti")
