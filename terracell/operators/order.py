"""Running totals over a whole ordered table without moving it to one task.

The order is cut at approximate quantiles into ranges.  Each range is a window partition of its own;
what lies before a range is a sum of one number a range, taken over at most ``ranges`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, order: str, by: list[str], ranges: int) -> DataFrame:
    """df with a range number __r that grows with ``order`` within each group of ``by``."""
    cuts = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(F.col(order), [i / ranges for i in range(1, ranges)], 1000)).alias("__cuts"))
    joined = df.join(F.broadcast(cuts), by) if by else df.crossJoin(F.broadcast(cuts))  # one row a group: groups are few
    return joined.withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")


def running(df: DataFrame, order: str, sums: dict[str, Column], by: list[str] | None = None, descending: bool = False, ranges: int = 64, ties: bool = True, then: list[str] | None = None) -> DataFrame:
    """df with running sums over ``order`` within ``by`` (few groups). ties: equal keys get the total of all; else each row its own, in order of ``then``."""
    by = by or []
    ranged = _ranged(df, order, by, ranges)
    direction = F.desc if descending else F.asc
    totals = ranged.groupBy(*by, "__r").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(direction("__r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__r", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    w = Window.partitionBy(*by, "__r").orderBy(direction(order), *(then or []))
    w = w.rangeBetween(Window.unboundedPreceding, 0) if ties else w.rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    out = inside.join(F.broadcast(offsets), [*by, "__r"])  # at most ``ranges`` rows a group
    return out.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums}).drop("__r", *[f"__o_{n}" for n in sums])


def average_rank(df: DataFrame, value: str, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with the rank of ``value`` from 1, equal values sharing the mean of their places. Null values are left out."""
    by = by or []
    known = df.where(F.col(value).isNotNull())
    sizes = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(sizes, value, {"__upto": F.col("__n")}, by)
    ranks = placed.select(*by, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return known.join(ranks, [*by, value])


def numbered(df: DataFrame, order: str, out: str, then: list[str] | None = None) -> DataFrame:
    """df with 1, 2, ... n in the given order, which must be total."""
    return running(df, order, {out: F.lit(1).cast("long")}, ties=False, then=then)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
