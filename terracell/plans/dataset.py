"""From cells and occurrences to a supervised table, and from models to a score for every valid cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite, padded_id
from ..grid import GridSpec
from ..operators import contracts, ml, neighbors, order, raster, sampling


@dataclass
class Inputs:
    """A grid, its wide cell table (cell_id, row, col, inside, features), points (id, x, y) to learn from, and points (x, y) that keep background away."""

    grid: GridSpec
    cells: DataFrame
    occurrences: DataFrame
    exclusion: DataFrame
    features: list[str]
    code: str


def valid_cells(inputs: Inputs) -> DataFrame:
    g = inputs.grid
    d = raster.joint_valid(inputs.cells, [*inputs.features, inputs.code], F.col("inside"))
    return d.withColumns({"x": g.x(F.col("col")), "y": g.y(F.col("row"))})


def positives(inputs: Inputs, valid: DataFrame) -> DataFrame:
    """(cell_id, n, ids). An occurrence outside the grid or the mask raises: none is dropped silently."""
    inside, outside = neighbors.points_to_cells(inputs.occurrences, inputs.grid, valid)
    contracts.require(outside.limit(1), {"occurrence outside the valid cells": F.lit(True)})
    return neighbors.occurrences(inside, "id")


def candidates(inputs: Inputs, valid: DataFrame, hits: DataFrame, radius: float) -> DataFrame:
    """Valid cells without an occurrence whose centre is at least ``radius`` from every excluding point."""
    free = valid.join(hits.select("cell_id"), "cell_id", "left_anti").withColumnRenamed("cell_id", "id")
    return neighbors.distance_anti_join(free, inputs.exclusion, radius).withColumnRenamed("id", "cell_id")


def assemble(inputs: Inputs, radius: float = 60.0, seed: int = 42, count: int | None = None) -> DataFrame:
    """The supervised table: positives, then as many sampled background cells (or ``count``), numbered in that order."""
    valid = valid_cells(inputs)
    hits = positives(inputs, valid)
    n = hits.count() if count is None else count
    background = sampling.sample_ids(candidates(inputs, valid, hits, radius), "cell_id", n, seed)
    none = [F.lit(0).cast("long").alias("n"), F.lit("[]").alias("ids"), F.lit(0).alias("target"), F.lit("background").alias("sample_type")]
    rows = hits.select("cell_id", "n", "ids", F.lit(1).alias("target"), F.lit("positive").alias("sample_type")).unionByName(background.select("cell_id", *none))
    table = rows.join(valid.select("cell_id", "row", "col", "x", "y", *inputs.features, inputs.code), "cell_id")
    keyed = order.numbered(table.withColumn("__first", 1 - F.col("target")).withColumn("__key", F.col("__first") * F.lit(1 << 62) + F.col("cell_id")), "__key", "__n")
    return keyed.withColumn("sample_id", padded_id("sample_", F.col("__n"))).drop("__first", "__key", "__n")


def audit(table: DataFrame, inputs: Inputs, radius: float = 60.0) -> DataFrame:
    """(rule, violations) of a supervised table against its sources, distances taken independently of how it was made."""
    valid = valid_cells(inputs).select("cell_id", F.lit(True).alias("valid"))
    near = neighbors.closer_than(table.where("target = 0").select(F.col("cell_id").alias("id"), "x", "y"), inputs.exclusion, radius).select(F.col("id").alias("cell_id"), F.lit(True).alias("near"))
    met = table.join(valid, "cell_id", "left").join(near, "cell_id", "left")
    g = inputs.grid
    rules = {f"finite {f}": ~finite(F.col(f)) for f in inputs.features}
    rules |= {
        "valid cell": F.col("valid").isNull(),
        "background too near": F.col("near").isNotNull(),
        "label": (F.col("target") == 1) != (F.col("n") > 0),
        "centre": (F.col("x") != g.x(F.col("col"))) | (F.col("y") != g.y(F.col("row"))),
        "cell number": F.col("cell_id") != g.cell_id(F.col("row"), F.col("col")),
    }
    return contracts.violations(met, rules)


def score_surface(inputs: Inputs, models: dict[str, ml.Classifier]) -> DataFrame:
    """(cell_id, row, col, x, y, a score a model, ensemble): every valid cell; narrow, without a shuffle."""
    d = valid_cells(inputs)
    for name, model in models.items():
        d = model.scores(d, name)
    mean = sum((F.col(n).cast("double") for n in models), F.lit(0.0)) / len(models)
    return d.select("cell_id", "row", "col", "x", "y", *models, mean.alias("ensemble"))
