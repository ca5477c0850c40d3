"""Exact nearest neighbour between two large sets by a tree of grid cells.

The box that holds all centres is halved along every axis, level by level, and only cells that hold more than LEAF different places are
halved again, so dense regions get small cells. Each cell knows the box that its centres fill and the outermost of them along each axis.
A point (equal ones are one) first gets a radius: the distance of the best centre among those of the cells on its own way down and of its own leaf. Then
it goes down the tree again, into every cell whose box is not beyond the radius (none beyond can win, as a centre stands at it). A level is
one equi join by cell in both walks; what is left at the leaves is joined with the leaves' centres and compared.

Scale: a point is one row on its first way and has a few rows on the second; only the leaves that it reaches are written, once, and no level is shuffled
while the table of cells is small enough to be broadcast. A leaf has at most LEAF different places; places that repeat are one. Levels end with the
deepest leaf, at most DEPTH.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.shared import written

#: Different places in a leaf; levels at most (cells of equal doubles are not halved further than this).
LEAF, DEPTH = 32, 20


class Grid:
    """Cells of the box of the centres. A cell of a level is numbered by its place along each axis, DEPTH bits apiece."""

    def __init__(self, low: list[float], high: list[float]):
        self.low, self.size = low, [(h - l) or 1.0 for l, h in zip(low, high)]

    def cell(self, axes: list[str], level: int) -> Column:
        n = 1 << level
        places = [F.greatest(F.lit(0), F.least(F.floor(F.least((F.col(a) - lo) / size, F.lit(1.0)) * n), F.lit(n - 1))).cast("long") for a, lo, size in zip(axes, self.low, self.size)]
        return reduce(lambda x, y: x + y, [F.shiftleft(p, DEPTH * i) for i, p in enumerate(places)])


def square(axes: list[str], place: Column) -> Column:
    """Square of the distance between the row's point and a struct of the axes."""
    return reduce(lambda x, y: x + y, [(F.col(a) - place[a]) * (F.col(a) - place[a]) for a in axes])


def beyond(axes: list[str]) -> Column:
    """Square of the least distance between the row's point and its cell's box. Rounding keeps order, so it is never above that of a centre in the box."""
    parts = [F.greatest(F.col(f"low_{a}") - F.col(a), F.col(a) - F.col(f"high_{a}"), F.lit(0.0)) for a in axes]
    return reduce(lambda x, y: x + y, [p * p for p in parts])


def tree(places: DataFrame, axes: list[str], grid: Grid, leaf: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each level its cells (cell, parent, is_leaf, the box of their centres, known: some centres, in small leaves all), and the places of its leaves
    (cell, axes, label)."""
    cells, leaves, rest = [], [], places
    place = F.struct(*axes)
    sides = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]
    outermost = F.array(*[f(place, F.col(a)) for a in axes for f in (F.min_by, F.max_by)])
    for level in range(DEPTH + 1):
        held = rest.withColumn("cell", grid.cell(axes, level))
        parent = grid.cell(axes, level - 1) if level else F.lit(None).cast("long")
        counts = held.groupBy("cell").agg(F.count("*").alias("n"), F.max(parent).alias("parent"), outermost.alias("known"), *sides)
        own = written(counts.withColumn("is_leaf", (F.col("n") <= leaf) | F.lit(level == DEPTH)).drop("n"), "cells")
        both = written(held.join(own.select("cell", "is_leaf"), "cell"), "places")
        ends = both.filter("is_leaf").drop("is_leaf")
        if level < DEPTH:
            all_of = ends.groupBy("cell").agg(F.collect_list(place).alias("__all"))  # at most ``leaf``
            own = own.join(all_of, "cell", "left").withColumn("known", F.coalesce("__all", "known")).drop("__all")
        cells.append(own)
        leaves.append(ends)
        rest = both.filter("not is_leaf").drop("is_leaf", "cell")
        if not rest.limit(1).count():
            break
    return cells, leaves


def with_radius(points: DataFrame, cells: list[DataFrame], axes: list[str], grid: Grid) -> DataFrame:
    """``points`` with radius, the square of the distance to the best of the centres that the cells on their way down know. Points outside of the box go down its edge."""
    best = F.array_min(F.transform("known", lambda p: square(axes, p)))
    out = points.withColumn("radius", F.lit(float("inf")))
    for level, own in enumerate(cells):
        side = own.select("cell", "known")
        out = out.withColumn("cell", grid.cell(axes, level))
        out = (out.join(side, "cell", "left") if level else out.join(F.broadcast(side), "cell", "left")).withColumn("radius", F.least("radius", best)).drop("cell", "known")
    return out


def reached(points: DataFrame, cells: list[DataFrame], axes: list[str]) -> DataFrame:
    """axes, radius, level, cell: the leaves whose boxes are not beyond a point's radius. A row that has come to a leaf stays there on the levels below."""
    boxes = [f"{n}_{a}" for a in axes for n in ("low", "high")]
    root = cells[0].select("cell", *boxes)
    state = points.join(F.broadcast(root)).filter(beyond(axes) <= F.col("radius")).drop(*boxes).withColumn("level", F.lit(0))  # one row
    for level, own in enumerate(cells[1:], 1):
        below = own.select(F.lit(level - 1).alias("level"), F.col("parent").alias("cell"), F.col("cell").alias("__child"), *boxes)
        step = state.join(below, ["level", "cell"], "left")
        inside = F.col("__child").isNull() | (beyond(axes) <= F.col("radius"))
        state = step.filter(inside).select(
            *axes, "radius", F.when(F.col("__child").isNull(), F.col("level")).otherwise(F.lit(level)).alias("level"), F.coalesce("__child", "cell").alias("cell"))
    return state


def nearest(points: DataFrame, centres: DataFrame, id_col: str, axes: list[str], label: str, leaf: int = LEAF) -> DataFrame:
    """id, label and distance (Euclid's) of the nearest centre of every point; ties go to the smaller label. Both sides have numeric
    ``axes`` (up to three). Points with a null or non-finite coordinate, and all points where there is no centre, get nulls; such centres take no
    part, nor do those with a null label. A row with a repeated id is a point like others."""
    fine = reduce(lambda x, y: x & y, [F.col(a).isNotNull() & ~F.isnan(F.col(a)) & (F.abs(F.col(a)) < float("inf")) for a in axes])
    numbers = [F.col(a).cast("double").alias(a) for a in axes]
    places = written(centres.select(*numbers, label).filter(fine).filter(F.col(label).isNotNull()).groupBy(*axes).agg(F.min(label).alias(label)), "centres")
    box = places.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]).first()
    lost = [F.lit(None).cast(places.schema[label].dataType).alias(label), F.lit(None).cast("double").alias("distance")]
    if box[f"low_{axes[0]}"] is None:
        return points.select(id_col, *lost)
    grid = Grid([box[f"low_{a}"] for a in axes], [box[f"high_{a}"] for a in axes])
    cells, leaves = tree(places, axes, grid, leaf)
    numbered = points.select(F.col(id_col), *numbers)
    asked = numbered.filter(fine)
    near = written(reached(with_radius(asked.select(*axes).distinct(), cells, axes, grid), cells, axes).drop("radius"), "near")
    held = reduce(lambda x, y: x.unionByName(y), [p.select(F.lit(i).alias("level"), "cell", F.struct(*axes).alias("__place"), label) for i, p in enumerate(leaves)])
    best = near.join(held, ["level", "cell"]).groupBy(*axes).agg(F.min(F.struct(square(axes, F.col("__place")).alias("d"), F.col(label))).alias("b"))
    out = asked.join(best, axes).select(id_col, F.col(f"b.{label}").alias(label), F.sqrt("b.d").alias("distance"))
    return out.unionByName(numbered.filter(~F.coalesce(fine, F.lit(False))).select(id_col, *lost))
