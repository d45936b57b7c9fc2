"""Points and polygons. A polygon is a list of closed rings of (x, y); even-odd, so a ring inside another is a hole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def edges(rings: list[Ring]) -> list[tuple[float, float, float, float]]:
    """Edges of closed rings of at least four points."""
    out = []
    for ring in rings:
        if len(ring) < 4 or ring[0] != ring[-1]:
            raise ValueError("a ring needs four points or more, the last equal to the first")
        out += [(*a, *b) for a, b in zip(ring, ring[1:])]
    return out


def _crossings(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Whether a ray to the right crosses an odd number of edges."""
    hits = []
    for x1, y1, x2, y2 in edges(rings):
        if y1 != y2:
            lo, hi = min(y1, y2), max(y1, y2)
            hits.append(F.when((y >= lo) & (y < hi) & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0))
    return reduce(lambda a, b: a + b, hits, F.lit(0)) % 2 == 1


def on_boundary(x: Column, y: Column, rings: list[Ring]) -> Column:
    out = F.lit(False)
    for x1, y1, x2, y2 in edges(rings):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        out = out | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return out


def within(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Strictly inside: points on the boundary are not."""
    return _crossings(x, y, rings) & ~on_boundary(x, y, rings)


def intersects(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Inside or on the boundary."""
    return _crossings(x, y, rings) | on_boundary(x, y, rings)


def boundary_distance2(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Squared distance to the nearest edge."""
    ds = []
    for x1, y1, x2, y2 in edges(rings):
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / n)) if n else F.lit(0.0)
        ds.append(F.pow(x - (F.lit(x1) + t * dx), 2) + F.pow(y - (F.lit(y1) + t * dy), 2))
    return F.least(*ds) if len(ds) > 1 else ds[0]


def within_buffer(x: Column, y: Column, rings: list[Ring], radius: float) -> Column:
    """Inside, or at most ``radius`` from the boundary."""
    return intersects(x, y, rings) | (boundary_distance2(x, y, rings) <= radius * radius)


def in_layer(points: DataFrame, layer: DataFrame, inclusive: bool = False, tile: float = 1000.0) -> DataFrame:
    """Distinct (point_id, polygon_id) of points (point_id, x, y) in polygons given as an edge table (polygon_id, x1, y1, x2, y2).

    For layers too large for literals.  Edges are dealt to the horizontal bands that they span, points
    to their own, so each point meets only the edges its ray could cross: an equi-join, no nested loop.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = layer.withColumn("band", F.explode(F.sequence(F.floor(low / tile), F.floor(high / tile))))
    met = points.withColumn("band", F.floor(F.col("y") / tile)).join(banded, "band")
    x, y = F.col("x"), F.col("y")
    at = F.col("x1") + (y - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    hit = (F.col("y1") != F.col("y2")) & (y >= low) & (y < high) & (x < at)
    cross = (x - F.col("x1")) * (F.col("y2") - F.col("y1")) - (y - F.col("y1")) * (F.col("x2") - F.col("x1"))
    touch = (cross == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(low, high)
    found = met.groupBy("point_id", "polygon_id").agg((F.count_if(hit) % 2 == 1).alias("odd"), F.bool_or(touch).alias("touch"))
    return found.where(F.col("odd") | F.col("touch") if inclusive else F.col("odd") & ~F.col("touch")).select("point_id", "polygon_id")


def lattice_dedup(df: DataFrame, x: str, y: str, order: str, tolerance: float = 0.01) -> DataFrame:
    """The first row, by ``order``, of those whose coordinates round (half to even) to the same lattice point."""
    lattice = [F.rint(F.col(c) / tolerance).alias(f"__{i}") for i, c in enumerate((x, y))]
    return df.groupBy(*lattice).agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("__row")).select("__row.*")


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: points, bounds, area of the bounds and points per unit of it (null if the area is 0)."""
    d = df.agg(F.count(F.lit(1)).alias("points"), *[f(c).alias(f"{f.__name__}_{c}") for c in (x, y) for f in (F.min, F.max)])
    area = (F.col(f"max_{x}") - F.col(f"min_{x}")) * (F.col(f"max_{y}") - F.col(f"min_{y}"))
    return d.withColumn("area", area).withColumn("density", F.try_divide(F.col("points").cast("double"), F.col("area")))


def transverse_mercator(lon: Column, lat: Column, zone_meridian: float = -51.0, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres on the GRS80 ellipsoid, by the sixth-order series in longitude; good to a few millimetres within a zone."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, dl = F.radians(lat), F.radians(lon - zone_meridian)
    n = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, A = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * dl
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = 500000 + k0 * n * (A + (1 - t + c) * F.pow(A, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(A, 5) / 120)
    north = k0 * (m + n * F.tan(phi) * (A * A / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(A, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(A, 6) / 720))
    return east, north + (10_000_000.0 if south else 0.0)
