"""Distance joins by buckets: an equi-join on grid squares instead of a nested loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite

#: Right points that a finest square holds on average, and levels of squares between two joins.
PER_SQUARE, LEVELS = 4, 2


def require_radius(radius: float) -> None:
    if not math.isfinite(radius) or radius < 0:
        raise ValueError(f"a radius must be finite and not negative: {radius}")


def _near_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs whose squares of side ``reach`` touch, with their squared distance d2. left (id, x, y), right (x, y)."""
    square = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    # Only squares and exact places matter on the right: equal points count once.
    points = right.select(F.col("x").alias("rx"), F.col("y").alias("ry"), square("x").alias("bx"), square("y").alias("by")).distinct()
    dealt = points.select("rx", "ry", "bx", "by", around).select("rx", "ry", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    met = left.withColumns({"bx": square("x"), "by": square("y")}).join(dealt, ["bx", "by"])
    return met.withColumn("d2", F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2)).drop("bx", "by")


def closer_than(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """ids of left rows with a right point at a distance below ``radius``."""
    require_radius(radius)
    if radius == 0:
        return left.select("id").limit(0)
    return _near_pairs(left, right, radius).where(F.col("d2") < radius * radius).select("id").distinct()


def distance_anti_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Left rows (id, x, y, ...) all of whose right points are at least ``radius`` away; a point at exactly that distance does not exclude.

    No right point at all, or one without finite coordinates, raises, as does a radius that is not finite or is negative.
    """
    require_radius(radius)
    n, bad = right.agg(F.count(F.lit(1)), F.count_if(~(finite(F.col("x")) & finite(F.col("y"))))).first()
    if not n or bad:
        raise ValueError(f"{n} points to keep away from, {bad} of them without finite coordinates")
    return left.join(closer_than(left.select("id", "x", "y"), right, radius), "id", "left_anti") if radius > 0 else left


def nearest_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, distance): from every left row (its id is its own) to its nearest right point, exactly; null if there is none, or the row has no finite place.

    The squares that hold right points form a pyramid.  A row starts with the few squares at its top and
    goes down LEVELS levels at a time: it keeps the squares that may hold its nearest point, those no
    farther at their nearest edge than the best of its squares is at its farthest, and only at the foot
    meets points.  So rows and pairs stay in proportion to left rows, wherever the points crowd.
    """
    points = right.select(F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry")).where(finite(F.col("rx")) & finite(F.col("ry"))).distinct()
    low_x, high_x, low_y, high_y, n = points.agg(F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry"), F.count(F.lit(1))).first()
    if not n:
        return left.select("id", F.lit(None).cast("double").alias("distance"))
    extent = max(high_x - low_x, high_y - low_y, 1e-9)
    steps = math.ceil(math.log2(max(1.0, math.sqrt(n / PER_SQUARE))) / LEVELS)
    foot = extent / 2 ** (LEVELS * steps)

    def square(c: str, low: float, side: float) -> Column:
        return F.floor((F.col(c) - low) / side)

    squares = points.select("rx", "ry", square("rx", low_x, foot).alias("bx"), square("ry", low_y, foot).alias("by"))
    up = lambda level, c: F.floor(F.col(c) / 2 ** (LEVELS * level))
    # The extent's far edges lie on squares of their own, so there are four at the top.
    four = F.array(*[F.struct(F.lit(i).cast("long").alias("sx"), F.lit(j).cast("long").alias("sy")) for i in (0, 1) for j in (0, 1)])
    near = left.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite(F.col("x")) & finite(F.col("y")))
    near = near.select("id", "x", "y", F.explode(four).alias("s")).select("id", "x", "y", "s.sx", "s.sy")
    for level in range(steps, -1, -1):
        side = foot * 2 ** (LEVELS * level)
        if level < steps:
            below = squares.select(up(level + 1, "bx").alias("sx"), up(level + 1, "by").alias("sy"), up(level, "bx").alias("cx"), up(level, "by").alias("cy")).distinct()
            near = near.join(below, ["sx", "sy"]).select("id", "x", "y", F.col("cx").alias("sx"), F.col("cy").alias("sy"))
        else:
            near = near.join(squares.select(up(level, "bx").alias("sx"), up(level, "by").alias("sy")).distinct(), ["sx", "sy"]).select("id", "x", "y", "sx", "sy")
        dx, dy = F.col("x") - low_x - F.col("sx") * side, F.col("y") - low_y - F.col("sy") * side
        out = lambda d: F.greatest(F.lit(0.0), -d, d - side)  # noqa: E731, B023
        far = lambda d: F.greatest(F.abs(d), F.abs(d - side))  # noqa: E731, B023
        near = near.withColumns({"least": out(dx) * out(dx) + out(dy) * out(dy), "most": far(dx) * far(dx) + far(dy) * far(dy)})
        # One row an id, its squares in an array: combined before the shuffle, and far fewer than a page of them.
        near = near.groupBy("id", "x", "y").agg(F.min("most").alias("most"), F.collect_list(F.struct("sx", "sy", "least")).alias("s"))
        slack = F.col("most") * (1 + 1e-9) + 1e-9 * side * side
        near = near.select("id", "x", "y", F.explode(F.filter("s", lambda q: q["least"] <= slack)).alias("s")).select("id", "x", "y", "s.sx", "s.sy")  # noqa: B023
    met = near.join(squares, (near["sx"] == squares["bx"]) & (near["sy"] == squares["by"]))
    found = met.groupBy("id").agg(F.sqrt(F.min(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2))).alias("distance"))
    return left.select("id").join(found, "id", "left")


def least_distance(left: DataFrame, right: DataFrame) -> float | None:
    """The least distance between a left and a right point, null if there is none. Acts on the data."""
    return nearest_distance(left.select("id", "x", "y"), right).agg(F.min("distance")).first()[0]


def min_distance_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(id, distance): from left rows to their nearest right point, of those below ``radius``."""
    require_radius(radius)
    return _near_pairs(left.select("id", "x", "y"), right, radius).where(F.col("d2") < radius * radius).groupBy("id").agg(F.sqrt(F.min("d2")).alias("distance"))


def points_to_cells(points: DataFrame, grid, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with their cell_id, and those outside the grid or its mask, which a caller must treat as an error, not drop."""
    placed = points.withColumns({"row": grid.row(F.col("y")), "col": grid.col(F.col("x"))}).withColumn("cell_id", F.when(grid.inside(F.col("row"), F.col("col")), grid.cell_id(F.col("row"), F.col("col"))))
    return placed.join(mask.select("cell_id"), "cell_id", "left_semi"), placed.join(mask.select("cell_id"), "cell_id", "left_anti")


def occurrences(points: DataFrame, point_id: str) -> DataFrame:
    """(cell_id, n, ids) for points with a cell: ids ascending, as compact JSON."""
    return points.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.array_sort(F.collect_list(point_id))).alias("ids"))
