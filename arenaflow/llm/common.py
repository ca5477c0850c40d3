"""Shared small helpers: table reading, written intermediates, word arrays."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arenaflow.shared import shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(df: DataFrame, name: str, which: Column) -> tuple[DataFrame, int]:
    """``written``, and how many of the rows hold ``which``, counted while they are written (rows of a repeated task may count twice)."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if(which).alias("n")), name)
    return out, seen.get["n"]


#: Rows, so texts or pairs of texts, that a Python worker gets at a time.
AT_ONCE = 1000


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = AT_ONCE):
    """Inside, Python functions get at most so many rows at a time: what is written there needs memory for as many long texts only."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def hashed(words: list[str]) -> np.ndarray:
    """A 64-bit value for every word, the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True)


def chunks(texts, limit: int = 1_000_000):
    """Index ranges of consecutive texts with about ``limit`` characters, so that Python objects stay few."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
