"""Filters as data: what a caller may ask for becomes one Column over plain columns, so that it reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days by which a window lies back.
SHIFTS = {"current": lambda days: 0, "prior": lambda days: days, "year_ago": lambda days: 365}


@dataclass(frozen=True)
class Spec:
    """``equal``: column -> value or list of values, None asks for nothing; ``days`` before ``now`` (a window that is open at its end, moved
    back by ``shift``); ``since``: from this time on; ``at_least``: column -> least value; ``hidden``: a column of rows to leave out."""

    equal: dict = field(default_factory=dict)
    at: str | None = None
    now: datetime | date | None = None
    days: int | None = None
    shift: str = "current"
    since: datetime | date | None = None
    at_least: dict = field(default_factory=dict)
    hidden: str | None = None


def window(now: datetime, days: int, shift: str = "current") -> tuple[datetime, datetime]:
    """From (inside) and to (outside) of ``days`` days; ``shift`` names a window of SHIFTS."""
    end = now - timedelta(days=SHIFTS[shift](days))
    return end - timedelta(days=days), end


def conditions(spec: Spec) -> list[Column]:
    """One condition for each thing asked for. Columns stay bare on their side, as only then a source can use them."""
    out = []
    for name, want in spec.equal.items():
        if want is None:
            continue
        values = list(want) if isinstance(want, (list, tuple, set, frozenset)) else [want]
        out.append(F.col(name).isin(values) if len(values) != 1 else F.col(name) == F.lit(values[0]))
    if spec.days is not None:
        low, high = window(spec.now, spec.days, spec.shift)
        out += [F.col(spec.at) >= F.lit(low).cast("timestamp_ntz"), F.col(spec.at) < F.lit(high).cast("timestamp_ntz")]
    if spec.since is not None:
        out.append(F.col(spec.at) >= F.lit(spec.since).cast("timestamp_ntz"))
    out += [F.col(name) >= F.lit(least) for name, least in spec.at_least.items() if least is not None]
    if spec.hidden:
        out.append(F.col(spec.hidden).isNull() | (F.col(spec.hidden) == F.lit(False)))
    return out


def where(rows: DataFrame, spec: Spec) -> DataFrame:
    for condition in conditions(spec):
        rows = rows.filter(condition)
    return rows


def clamped(least: int | None, floor: int = 5) -> int:
    """A caller's least number of matches, never below the floor."""
    return max(least or 0, floor)
