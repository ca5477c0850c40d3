"""Connected components by joins, whole or after a few changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arenaflow.shared import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root (the smallest id of its component) of every end of ``edges``; rows with a null end are left out. Each round a node takes the smallest root
    among its neighbours and then that root's root, until nothing changes: the rounds grow with the logarithm of the longest chain.
    Partial minima meet a hub, never its rows."""
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("id"), F.col(b).alias("to"))
    both = written(ends.union(ends.select("to", "id")).distinct(), "edges")
    state = written(both.groupBy("id").agg(F.least("id", F.min("to")).alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("id").alias("to"), "root"), "to").groupBy("id").agg(F.min("root").alias("near"))
        step = written(state.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root")), "steps")
        up = step.select(F.col("id").alias("root"), F.col("root").alias("above"))
        seen = Observation()
        new = step.join(up, "root").select("id", F.least("root", "above").alias("root"), "old").observe(seen, F.count_if(F.col("root") != F.col("old")).alias("n"))
        new = written(new.select("id", "root"), "roots")
        forget(state, step)
        state = new
        if not seen.get["n"]:
            forget(both)
            return state
