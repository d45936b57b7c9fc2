"""Grids: the geometry that aligned rasters share. Kept on the driver, closed over as literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A grid without rotation. dy > 0 means that y grows with the row, dy < 0 that row 0 is northernmost."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    epsg: int = 31982

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0 or self.dx <= 0 or self.dy == 0:
            raise ValueError("a grid needs a positive size and cell width, and a cell height other than 0")

    def x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.dx

    def y(self, row: Column) -> Column:
        return F.lit(self.y0) + (row + 0.5) * self.dy

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.dx).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((y - self.y0) / self.dy).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)

    def cell_id(self, row: Column, col: Column) -> Column:
        return row.cast("long") * self.width + col

    def dense(self, spark: SparkSession) -> DataFrame:
        """(cell_id, row, col) of every cell, generated in parallel."""
        ids = spark.range(self.width * self.height).withColumnRenamed("id", "cell_id")
        return ids.select("cell_id", (F.col("cell_id") / self.width).cast("int").alias("row"), (F.col("cell_id") % self.width).cast("int").alias("col"))

    def require_match(self, other: "GridSpec") -> None:
        """Grids must be equal in every field before their rasters are joined by cell."""
        if self != other:
            raise ValueError(f"grids differ: {self} and {other}")

    def require_metric(self, size: float = 30.0) -> None:
        """North-up, square cells of the given size."""
        if self.dy >= 0 or self.dx != size or -self.dy != size:
            raise ValueError(f"not a north-up grid of {size} m cells: {self}")
