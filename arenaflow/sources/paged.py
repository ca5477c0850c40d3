"""A paged feed as a data source, batch and stream: ``spark.read.format("arena_pages")``.

Pages are numbered files ``page-000001.json`` in a folder that all executors see: recorded answers of a paged service, a list of JSON objects each, or an object
with the list under ``rows``. Options: ``path``; ``pages`` in a task (1 by default); ``since``, a least value of the field ``order`` (strictly
after it, as a high-water mark asks); ``limit``, the most pages in a batch of a stream.

Pages are dealt to tasks by ranges. Only the fields of the asked schema are taken out of the objects, so that a narrow schema ships narrow rows. A page that
can't be read gives one row with its text in ``_broken`` (where the schema has that column) and no others, and stops nothing. The stream's offset is the number of the last page, so a
restart goes on behind it; pages are never changed once they are there.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = re.compile(r"page-(\d+)\.json$")


class Pages(InputPartition):
    """Pages from ``first`` to ``last``, both inside."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def folder(path: str) -> str:
    return path.removeprefix("file://")


def page_numbers(path: str) -> list[int]:
    return sorted(int(m[1]) for m in map(NAME.search, os.listdir(folder(path))) if m)


def ranges(numbers: list[int], size: int) -> list[Pages]:
    """Runs of ``size`` pages, gaps in their numbers left as they are."""
    return [Pages(part[0], part[-1]) for part in (numbers[i : i + size] for i in range(0, len(numbers), size))]


def fitting(value, kind: T.DataType):
    """A JSON value as the type asks, null where it doesn't fit."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    raise ValueError(f"fields of type {kind.simpleString()} aren't read from pages")


def rows_of(text: str, schema: T.StructType, order: str | None, since: str | None) -> Iterator[tuple]:
    """The rows of a page after the mark, or one broken row."""
    try:
        found = json.loads(text)
        found = found["rows"] if isinstance(found, dict) else found
        if not isinstance(found, list) or not all(isinstance(r, dict) for r in found):
            raise ValueError("not a list of objects")
    except (ValueError, KeyError):
        if "_broken" in schema.names:
            yield tuple(text if f.name == "_broken" else None for f in schema)
        return
    for r in found:
        if order is None or since is None or (r.get(order) is not None and str(r[order]) > since):
            yield tuple(None if f.name == "_broken" else fitting(r.get(f.name), f.dataType) for f in schema)


class Reading:
    """What batch and stream share."""

    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.wanted = options["path"], schema
        self.size, self.limit = int(options.get("pages", 1)), int(options.get("limit", 0))
        self.order, self.since = options.get("order"), options.get("since")
        for f in schema:
            fitting("" if isinstance(f.dataType, T.StringType) else None, f.dataType)

    def read(self, partition: Pages) -> Iterator[tuple]:
        for n in page_numbers(self.path):
            if partition.first <= n <= partition.last:
                with open(os.path.join(folder(self.path), f"page-{n:06d}.json"), encoding="utf-8", errors="replace") as f:
                    text = f.read()
                yield from rows_of(text, self.wanted, self.order, self.since)


class PagesReader(Reading, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return ranges(page_numbers(self.path), self.size)


class PagesStream(Reading, DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.reached: int | None = None

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        numbers = page_numbers(self.path)
        if self.limit and self.reached is not None:
            numbers = [n for n in numbers if n > self.reached][: self.limit] or [self.reached]
        return {"page": numbers[-1] if numbers else 0}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return ranges([n for n in page_numbers(self.path) if start["page"] < n <= end["page"]], self.size)

    def commit(self, end: dict) -> None:
        self.reached = end["page"]


class ArenaPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arena_pages"

    def schema(self) -> str:
        return "_broken string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagesReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PagesStream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArenaPages)
