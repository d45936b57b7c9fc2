"""Rasters as wide cell tables: masks, derivatives, indices, composites, resampling.

A table has one row a cell with integer ``row`` and ``col``; a null value is no data.  Derivatives need
the grid dense: invalid cells are present with null values, and only the end result is masked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, safe_div

#: Fixed values of scene classification: codes that make a pixel invalid.
INVALID_CLASSES = (0, 1, 3, 8, 9, 10, 11)
#: Curvature is undefined on slopes below this many degrees.
MIN_SLOPE = 0.1


def joint_valid(df: DataFrame, features: list[str], inside: Column) -> DataFrame:
    """Cells inside whose features are all finite."""
    keep = inside
    for f in features:
        keep = keep & finite(F.col(f))
    return df.where(keep)


def gradient(df: DataFrame, value: str, axis: str, size: int, spacing: float, out: str) -> DataFrame:
    """df with the derivative along ``axis`` ("row" or "col"): central inside, one-sided at the first and last index; null spreads to what is computed from it."""
    other = "col" if axis == "row" else "row"
    w = Window.partitionBy(other).orderBy(axis)
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    inner = (after - before) / (2 * spacing)
    return df.withColumn(out, F.when(F.col(axis) == 0, (after - v) / spacing).when(F.col(axis) == size - 1, (v - before) / spacing).otherwise(inner))


def slope_aspect(df: DataFrame, z: str, width: int, height: int, cell: float) -> DataFrame:
    """df with slope in degrees and aspect, the azimuth of the way down in [0, 360); rows run southwards. Flat cells face north."""
    d = gradient(df, z, "col", width, cell, "__p")
    d = gradient(d, z, "row", height, cell, "__q")
    p, q = F.col("__p"), -F.col("__q")
    slope = F.degrees(F.atan(F.sqrt(p * p + q * q)))
    # -p and -q of a flat cell would be negative zeros, which turn the angle round.
    aspect = F.pmod(F.degrees(F.atan2(0.0 - p, 0.0 - q)) + 360, F.lit(360.0))
    return d.withColumns({"slope": slope, "aspect": aspect}).drop("__p", "__q")


def curvature(df: DataFrame, z: str, width: int, height: int, cell: float) -> DataFrame:
    """df with profile_curvature and plan_curvature; null where the gradient is below tan(0.1 degrees)."""
    d = gradient(df, z, "col", width, cell, "__p")
    d = gradient(d, z, "row", height, cell, "__dr")
    d = gradient(d, "__p", "col", width, cell, "__r")
    d = gradient(d, "__p", "row", height, cell, "__pr")
    d = gradient(d, "__dr", "row", height, cell, "__t")
    p, q, r, s, t = F.col("__p"), -F.col("__dr"), F.col("__r"), -F.col("__pr"), F.col("__t")
    g = p * p + q * q
    steep = F.sqrt(g) >= math.tan(math.radians(MIN_SLOPE))
    profile = -(r * p * p + 2 * s * p * q + t * q * q) / (g * F.pow(1 + g, F.lit(1.5)))
    plan = (r * q * q - 2 * s * p * q + t * p * p) / F.pow(g, F.lit(1.5))
    return d.withColumns({"profile_curvature": F.when(steep, profile), "plan_curvature": F.when(steep, plan)}).drop("__p", "__dr", "__r", "__pr", "__t")


def reflectance(dn: Column, scale: float, offset: float, nodata: float | None = 0) -> Column:
    """dn * scale + offset; null where dn is null, not finite or no data, which is tested before scaling."""
    ok = finite(dn) if nodata is None else finite(dn) & (dn != nodata)
    return F.when(ok, dn * scale + offset)


def ndvi(nir: Column, red: Column) -> Column:
    """(nir - red) / (nir + red); null where the sum is 0 or not finite, or the result lies outside [-1, 1]."""
    v = F.when(finite(nir + red), safe_div(nir - red, nir + red))
    return F.when(v.between(-1, 1), v)


def temporal_composite(stack: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Per cell the median of the valid observations (null if there is none) and their number."""
    v = F.when(finite(F.col(value)), F.col(value))
    return stack.groupBy(*cell).agg(F.median(v).alias("median"), F.count(v).alias("n_obs"))


def class_histogram(df: DataFrame, code: str, codes: range | None = None) -> DataFrame:
    """(code, pixels, percent); with ``codes``, exactly those, zeros included."""
    counted = df.where(F.col(code).isNotNull()).groupBy(F.col(code).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("pixels"))
    if codes is not None:
        dims = df.sparkSession.range(codes.start, codes.stop).select(F.col("id").cast("int").alias("code"))
        counted = dims.join(counted, "code", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)).cast("long"))
    total = F.sum("pixels").over(Window.partitionBy())  # over one row a code
    return counted.withColumn("percent", safe_div(F.col("pixels") * 100.0, total))


def edge_distance(df: DataFrame, valid: Column, width: int, height: int, most: int = 3) -> DataFrame:
    """(row, col, distance) of valid cells: to the nearest invalid or outside cell, in cells; infinite beyond ``most``.

    Every cell looks at the offsets of a disc: an equi-join with the valid cells, no search.
    """
    cells = df.where(valid).select("row", "col")
    disc = [(a, b) for a in range(-most, most + 1) for b in range(-most, most + 1) if 0 < a * a + b * b <= most * most]
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in disc])).alias("o")
    looked = cells.select("row", "col", offsets).select("row", "col", (F.col("row") + F.col("o.dr")).alias("r2"), (F.col("col") + F.col("o.dc")).alias("c2"), F.sqrt((F.col("o.dr") ** 2 + F.col("o.dc") ** 2).cast("double")).alias("d"))
    there = cells.select(F.col("row").alias("r2"), F.col("col").alias("c2"))
    gaps = looked.join(there, ["r2", "c2"], "left_anti").groupBy("row", "col").agg(F.min("d").alias("distance"))
    return cells.join(gaps, ["row", "col"], "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def resample_nearest(df: DataFrame, value: str, factor: float, width: int, height: int) -> DataFrame:
    """Source cells onto a grid whose cells are ``factor`` source cells wide: the value at each target centre. (row, col, value)"""
    grid = df.sparkSession.range(width * height).select((F.col("id") / width).cast("int").alias("t_row"), (F.col("id") % width).cast("int").alias("t_col"))
    at = lambda c: F.floor((F.col(c) + 0.5) * factor).cast("int")
    placed = grid.select("t_row", "t_col", at("t_row").alias("row"), at("t_col").alias("col"))
    return placed.join(df.select("row", "col", F.col(value).alias("value")), ["row", "col"], "left").select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), "value")


def resample_average(df: DataFrame, value: str, factor: int) -> DataFrame:
    """Mean of the valid source cells of each target cell of ``factor`` x ``factor``. (row, col, value)"""
    return df.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg(value).alias("value"))


def resample_bilinear(df: DataFrame, value: str, factor: float, width: int, height: int) -> DataFrame:
    """Weighted mean of the four source centres around each target centre, the weights of valid ones made to sum to 1. (row, col, value)"""
    grid = df.sparkSession.range(width * height).select((F.col("id") / width).cast("int").alias("t_row"), (F.col("id") % width).cast("int").alias("t_col"))
    pos = lambda c: (F.col(c) + 0.5) * factor - 0.5
    base = grid.withColumns({"__y": pos("t_row"), "__x": pos("t_col")}).withColumns({"__r": F.floor("__y").cast("int"), "__c": F.floor("__x").cast("int")})
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k")
    near = base.select("*", corners).withColumns({"row": F.col("__r") + F.col("k.a"), "col": F.col("__c") + F.col("k.b")})
    part = lambda k, p, f: F.when(k == 1, F.col(p) - F.col(f)).otherwise(1 - (F.col(p) - F.col(f)))
    weighed = near.withColumn("w", part(F.col("k.a"), "__y", "__r") * part(F.col("k.b"), "__x", "__c"))
    met = weighed.join(df.select("row", "col", F.col(value).alias("value")).where("value IS NOT NULL"), ["row", "col"])
    got = met.groupBy("t_row", "t_col").agg(safe_div(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"))
    return grid.join(got, ["t_row", "t_col"], "left").select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), "value")


def dense_scores(grid: DataFrame, scores: DataFrame, score: str, nodata: float = -9999.0) -> DataFrame:
    """Every cell of the grid with its score as float, no-data where there is none."""
    return grid.join(scores.select("row", "col", score), ["row", "col"], "left").withColumn(score, F.coalesce(F.col(score).cast("float"), F.lit(nodata).cast("float")))


def coverage(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: cells (row, col) in both masks, missing from the second, and extra in it."""
    a, b = one.select("row", "col", F.lit(1).alias("a")), two.select("row", "col", F.lit(1).alias("b"))
    met = a.join(b, ["row", "col"], "full")
    return met.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


def sample_window(df: DataFrame, row: int, col: int, height: int, width: int, size: int = 64) -> DataFrame:
    """The ``size`` x ``size`` cells around a cell, moved inwards at the raster's edges: a range of rows and columns, which a scan can prune by."""
    top, left = (max(0, min(c - size // 2, n - size)) for c, n in ((row, height), (col, width)))
    return df.where(F.col("row").between(top, top + size - 1) & F.col("col").between(left, left + size - 1))


def invalid_share(df: DataFrame, code: str) -> DataFrame:
    """One row: pixels, invalid ones by their class (a missing class counts as 0, which is invalid), and their percent."""
    bad = F.coalesce(F.col(code), F.lit(0)).isin(*INVALID_CLASSES)
    return df.agg(F.count(F.lit(1)).alias("pixels"), F.count_if(bad).alias("invalid")).withColumn("percent", safe_div(F.col("invalid") * 100.0, F.col("pixels").cast("double")))


def require_clear(df: DataFrame, code: str, most: float = 1.0) -> DataFrame:
    """df without its invalid pixels; a scene with more than ``most`` percent of them raises. Acts on the data."""
    percent = invalid_share(df, code).first()["percent"]
    if percent is None or percent > most:
        raise ValueError(f"{percent} percent of the pixels are invalid")
    return df.where(~F.coalesce(F.col(code), F.lit(0)).isin(*INVALID_CLASSES))


def score_checks(scores: DataFrame, mask: DataFrame, score: str) -> DataFrame:
    """One row of counts that must be 0: scores (row, col) beside the mask's cells, missing, repeated, undefined or outside [0, 1]."""
    n = scores.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.count_if(~finite(F.col(score))).alias("undefined"))
    met = n.join(mask.select("row", "col", F.lit(1).alias("valid")), ["row", "col"], "full")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return met.agg(count(F.col("valid").isNull(), "beside_mask"), count(F.col("n").isNull(), "missing"), count(F.col("n") > 1, "repeated"), count(F.col("undefined") > 0, "undefined"), count((F.col("low") < 0) | (F.col("high") > 1), "out_of_range"))
