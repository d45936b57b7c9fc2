"""Reproducible samples, splits, spatial blocks and folds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rank_key
from .neighbors import closer_than, min_distance_within


@dataclass(frozen=True)
class SpatialConfig:
    """Blocks of ``block`` metres, a multiple of the cell size, and ``folds`` folds."""

    folds: int = 5
    block: float = 1500.0
    cell: float = 30.0
    seed: int = 42

    def __post_init__(self):
        if not isinstance(self.folds, int) or self.folds < 2:
            raise ValueError("folds must be an integer of 2 or more")
        if self.block <= 0 or self.block % self.cell:
            raise ValueError("the block size must be a positive multiple of the cell size")


def sample_ids(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """n distinct ids in an order that depends on seed and id only. Fewer ids than n raise; counts them."""
    if n < 0 or not isinstance(seed, int):
        raise ValueError("the count must not be negative and the seed must be an integer")
    ids = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    if ids.limit(n).count() < n:
        raise ValueError(f"fewer than {n} candidates")
    return ids.orderBy(rank_key(seed, F.col(column)), column).limit(n)


def sample_exact(ids: list[int], n: int, seed: int) -> list[int]:
    """n of the ascending unique ids by a PCG64 generator, ascending; for candidates that fit the driver."""
    unique = np.unique(np.asarray(ids, np.int64))
    if n > len(unique):
        raise ValueError(f"fewer than {n} candidates")
    return sorted(int(i) for i in np.random.Generator(np.random.PCG64(seed)).choice(unique, n, replace=False))


def stratified_split(df: DataFrame, target: str, key: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """df with ``split``: of each class exactly round(share * its rows), by a reproducible order, are "test", the rest "train".

    The cut of a class is found on a histogram of its keys' leading digits, then inside one bin only.
    """
    h = F.conv(F.substring(rank_key(seed, F.col(key)), 1, 4), 16, 10).cast("int")
    d = df.withColumn("__h", h)
    bins = d.groupBy(target, "__h").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(target).orderBy("__h"))  # at most 65,536 rows a class
    total = F.sum("__n").over(Window.partitionBy(target))
    placed = bins.select(target, "__h", (upto - F.col("__n")).alias("__before"), F.floor(total * share + 0.5).alias("__want"))
    inside = F.row_number().over(Window.partitionBy(target, "__h").orderBy(rank_key(seed, F.col(key)), key))
    return d.withColumn("__i", inside).join(placed, [target, "__h"]).withColumn("split", F.when(F.col("__before") + F.col("__i") <= F.col("__want"), "test").otherwise("train")).drop("__h", "__i", "__before", "__want")


def blocks(df: DataFrame, config: SpatialConfig, x: str = "x", y: str = "y") -> DataFrame:
    """df with block_x, block_y, block_id: half-open blocks counted from the least coordinate less half a cell."""
    low = df.agg(F.min(x).alias("__x0"), F.min(y).alias("__y0"))
    per = int(config.block / config.cell)
    at = lambda c, o: F.floor(F.rint((F.col(c) - F.col(o)) / config.cell) / per).cast("int")
    d = df.crossJoin(F.broadcast(low))  # one row
    return d.withColumns({"block_x": at(x, "__x0"), "block_y": at(y, "__y0")}).withColumn("block_id", F.concat_ws(":", "block_x", "block_y")).drop("__x0", "__y0")


def off_grid(df: DataFrame, config: SpatialConfig, x: str = "x", y: str = "y", tolerance: float = 1e-7) -> DataFrame:
    """Rows whose coordinates are no whole number of cells from the least; blocks are not defined for them."""
    low = df.agg(F.min(x).alias("__x0"), F.min(y).alias("__y0"))
    away = lambda c, o: F.abs((F.col(c) - F.col(o)) / config.cell - F.rint((F.col(c) - F.col(o)) / config.cell)) > tolerance
    return df.crossJoin(F.broadcast(low)).where(away(x, "__x0") | away(y, "__y0")).drop("__x0", "__y0")


def group_kfold(counts: list[tuple[str, int, int]], folds: int, seed: int) -> dict[str, int]:
    """Fold (from 1) of each block (id, positives, negatives), balanced by class; blocks are few and on the driver.

    Largest class imbalance first, ties by a seeded hash; each goes where both classes' shares end up
    most even.
    """
    total = np.array([sum(c[1] for c in counts), sum(c[2] for c in counts)], float)
    if len(counts) < folds:
        raise ValueError("fewer blocks than folds")
    order = sorted(counts, key=lambda c: (-np.std(np.array(c[1:]) / np.maximum(total, 1)), -c[1] - c[2], hashlib.md5(f"{seed}:{c[0]}".encode()).hexdigest()))
    held = np.zeros((folds, 2))
    out = {}
    for block, a, b in order:
        cost = []
        for f in range(folds):
            trial = held.copy()
            trial[f] += (a, b)
            cost.append((round(float((trial / np.maximum(total, 1)).std(axis=0).mean()), 12), held[f].sum(), f))
        f = min(cost)[2]
        held[f] += (a, b)
        out[block] = f + 1
    return out


def assign_folds(df: DataFrame, config: SpatialConfig, target: str = "target") -> DataFrame:
    """df (with block_id) and ``fold``. Collects one row a block. Fewer blocks, or rows of a class, than folds raise."""
    per = df.groupBy("block_id").agg(F.count_if(F.col(target) == 1).alias("a"), F.count_if(F.col(target) == 0).alias("b"))
    counts = [(r["block_id"], r["a"], r["b"]) for r in per.collect()]
    if min(sum(c[k] for c in counts) for k in (1, 2)) < config.folds:
        raise ValueError("fewer rows of a class than folds")
    folds = group_kfold(counts, config.folds, config.seed)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(sorted(folds.items()), "block_id string, fold int")), "block_id")


def buffered_train(df: DataFrame, fold: int, radius: float) -> tuple[DataFrame, DataFrame]:
    """Training rows (fold other than ``fold``; id, x, y, fold) that are kept, and those nearer than ``radius`` to a validation row; exactly at it they are kept."""
    train, valid = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
    near = closer_than(train.select("id", "x", "y"), valid, radius)
    return train.join(near, "id", "left_anti"), train.join(near, "id", "left_semi")


def buffer_membership(df: DataFrame, folds: list[int], radius: float) -> DataFrame:
    """(evaluation_fold, id, role, distance): every row once a fold, as validation, train or excluded; distance to validation where below ``radius``."""
    out = None
    for k in folds:
        valid = df.where(F.col("fold") == k)
        near = min_distance_within(df.where(F.col("fold") != k), valid, radius)
        role = F.when(F.col("fold") == k, "validation").when(F.col("distance").isNotNull(), "excluded").otherwise("train")
        part = df.select("id", "fold").join(near, "id", "left").select(F.lit(k).alias("evaluation_fold"), "id", role.alias("role"), "distance")
        out = part if out is None else out.unionByName(part)
    return out


def partition_faults(df: DataFrame, folds: int) -> Column:
    """Rules that an assignment to the folds 1, 2, ... must meet, as a struct of counts that must be 0, over (id, block_id, fold)."""
    known = F.col("fold").between(1, folds)
    return F.struct(
        F.count_if(F.col("fold").isNull()).alias("without_fold"), F.count_if(~known).alias("unknown_fold"), (F.lit(folds) - F.count_distinct(F.when(known, F.col("fold")))).alias("missing_folds"),
        (F.count("id") - F.count_distinct("id")).alias("repeated_id"), (F.count_distinct("block_id", "fold") - F.count_distinct("block_id")).alias("split_block"),
    )
