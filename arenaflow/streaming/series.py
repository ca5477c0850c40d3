"""Series of games that are settled by the clock: a best-of-n closes when its deadline has passed in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from arenaflow.operators import windows

GAMES = "series long, game long, at timestamp, a_won boolean"
RESULT = "series long, first timestamp, last timestamp, wins_a long, wins_b long, games long, winner string, status string"


def settle(games: list[tuple], target: int) -> tuple:
    """first, last, wins_a, wins_b, games, winner, status of the games (at, game, a_won) of a series: in order of time, up to the one that clinches; games
    without a winner count for nobody. A series that nobody clinches has expired."""
    wins, used, last = [0, 0], 0, None
    ordered = sorted(games, key=lambda g: (g[0], g[1]))
    for at, _, a_won in ordered:
        used, last = used + 1, at
        if a_won is not None:
            wins[0 if a_won else 1] += 1
        if max(wins) == target:
            break
    winner = "a" if wins[0] >= target else "b" if wins[1] >= target else None
    return ordered[0][0], last, wins[0], wins[1], used, winner, "decided" if winner else "expired"


def runs_of(games: list[tuple], quiet_ms: int) -> list[list[tuple]]:
    """The games (at, game, a_won) of a series in runs without a pause of more than ``quiet_ms``."""
    out: list[list[tuple]] = []
    for g in sorted(games, key=lambda g: (g[0], g[1])):
        if out and millis(g[0]) - millis(out[-1][-1][0]) <= quiet_ms:
            out[-1].append(g)
        else:
            out.append([g])
    return out


def millis(at) -> int:
    return pd.Timestamp(at).value // 1_000_000


class Settling(StatefulProcessor):
    """The open games of a series, one state entry each, and a timer ``quiet`` after the end of the first run of them."""

    def __init__(self, target: int, quiet_ms: int):
        self.target, self.quiet = target, quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.games = handle.getMapState("games", "game long, at timestamp", "a_won boolean")
        self.due = handle.getValueState("due", "at long")

    def held(self) -> list[tuple]:
        return [(k[1], k[0], v[0]) for k, v in self.games.iterator()]

    def schedule(self, games: list[tuple]) -> None:
        """The timer at the end of the first run; none without games."""
        old = self.due.get()[0] if self.due.exists() else None
        new = millis(runs_of(games, self.quiet)[0][-1][0]) + self.quiet if games else None
        if new == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is None:
            self.due.clear()
        else:
            self.handle.registerTimer(new)
            self.due.update((new,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples(index=False):
                self.games.updateValue((int(r.game), r.at.to_pydatetime()), (None if r.a_won is None or r.a_won != r.a_won else bool(r.a_won),))
        self.schedule(self.held())
        yield pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left, out = timerValues.getCurrentWatermarkInMs(), [], []
        for run in runs_of(self.held(), self.quiet):
            if millis(run[-1][0]) + self.quiet <= now:
                out.append((key[0], *settle(run, self.target)))
                for at, game, _ in run:
                    self.games.removeKey((game, at))
            else:
                left += run
        self.due.clear()
        self.schedule(left)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def settled_series(games: DataFrame, target: int = 2, quiet_minutes: float = 10, late: str = "5 minutes") -> DataFrame:
    """A row for each series once no game of it came for ``quiet_minutes`` of event time: games (GAMES) that come late but before that count where they
    belong, a game that is delivered again counts once, and what comes later begins a series anew. Needs the state store of RocksDB."""
    open_ = games.withWatermark("at", late).groupBy("series")
    return open_.transformWithStateInPandas(Settling(target, int(quiet_minutes * 60_000)), RESULT, "Append", "EventTime")


def series_results(games: DataFrame, target: int = 2, quiet_minutes: float = 10) -> DataFrame:
    """The same for a table: runs of a series' games without a longer pause, each up to its clinch."""
    one = games.dropDuplicates(["series", "game", "at"])
    w = W.partitionBy("series").orderBy("at", "game")
    pause = F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > quiet_minutes * 60_000_000
    runs = windows.islands(one, ["series"], "at", pause, "run", "game")
    ended = windows.first_to(runs.withColumn("__side", F.when(F.col("a_won"), 1).when(~F.col("a_won"), 0)), ["series", "run"], ["at", "game"], "__side", target)
    r = ended.groupBy("series", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count_if("a_won").alias("wins_a"), F.count_if(~F.col("a_won")).alias("wins_b"), F.count("*").alias("games"))
    winner = F.when(F.col("wins_a") >= target, "a").when(F.col("wins_b") >= target, "b")
    return r.select("series", "first", "last", "wins_a", "wins_b", "games", winner.alias("winner"), F.when(winner.isNull(), "expired").otherwise("decided").alias("status"))
