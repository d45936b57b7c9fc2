"""The driver's queries: for each a function of (spark, sf_dir) and, where SQL can say it, DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import catalog, contracts, metrics, ml, neighbors, order, provenance, raster, sampling, stats, vector
from .fixtures import CELL, CELLS, HOLE, OUTER, POINTS, SCORED, STACK, WIDTH, cells, grid, height, points, scored, stack, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tidied(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros."""
    return df.select(*[fn.tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(c: str, name: str | None = None, digits: int = 6) -> str:
    """SQL for a rounded number."""
    return f"round(CAST({c} AS DOUBLE), {digits}) + 0 AS {name or c}"


# ---- grids and rasters


@query(f"WITH {CELLS} SELECT cell_id, x, y FROM cells")
def grid_centers(spark, sf):
    g = grid(spark, sf)
    return g.dense(spark).select("cell_id", g.x(F.col("col")).alias("x"), g.y(F.col("row")).alias("y"))


@query(f"WITH {CELLS} SELECT row, col, round(CAST(CASE WHEN land_cover <> 3 THEN CAST((z - 900) / 200 AS FLOAT) ELSE -9999 END AS DOUBLE), 6) + 0 AS score FROM cells")
def grid_dense_left_join(spark, sf):
    scores = cells(spark, sf).where("land_cover <> 3").select("row", "col", ((F.col("z") - 900) / 200).alias("score"))
    dense = raster.dense_scores(grid(spark, sf).dense(spark).select("row", "col"), scores, "score")
    return tidied(dense.select("row", "col", F.col("score").cast("double").alias("score")))


@query(f"WITH {CELLS} SELECT cell_id, z, land_cover FROM cells WHERE land_cover <> 0 AND x >= 100 AND x <= 1400")
def grid_joint_mask(spark, sf):
    d = cells(spark, sf).withColumn("z", F.when(F.col("land_cover") != 0, F.col("z")))
    return raster.joint_valid(d, ["z", "land_cover"], F.col("x").between(100, 1400)).select("cell_id", "z", "land_cover")


def _gradient_sql(value: str, axis: str, out: str, source: str) -> str:
    other = "row" if axis == "col" else "col"
    w = f"OVER (PARTITION BY {other} ORDER BY {axis})"
    return f"""SELECT *, CASE WHEN {axis} = 0 THEN (lead({value}) {w} - {value}) / 30.0::DOUBLE
      WHEN {axis} = (SELECT max({axis}) FROM cells) THEN ({value} - lag({value}) {w}) / 30.0::DOUBLE
      ELSE (lead({value}) {w} - lag({value}) {w}) / 60.0::DOUBLE END AS {out} FROM {source}"""


_PQ = f"""{CELLS}, g1 AS ({_gradient_sql('z', 'col', 'p', 'cells')}), g2 AS ({_gradient_sql('z', 'row', 'dr', 'g1')})"""
_SLOPE = f"""{_PQ}, terrain AS (SELECT *, degrees(atan(sqrt(p * p + dr * dr))) AS slope,
  fmod(degrees(atan2(0.0::DOUBLE - p, 0.0::DOUBLE + dr)) + 360, 360.0::DOUBLE) AS aspect FROM g2)"""


@query(f"WITH {_PQ} SELECT cell_id, {r('p', 'dz_dx')}, {r('dr', 'dz_dy')} FROM g2")
def grid_gradient(spark, sf):
    d = raster.gradient(cells(spark, sf), "z", "col", WIDTH, CELL, "dz_dx")
    d = raster.gradient(d, "z", "row", height(spark, sf), CELL, "dz_dy")
    return tidied(d.select("cell_id", "dz_dx", "dz_dy"))


def _terrain(spark, sf):
    return raster.slope_aspect(cells(spark, sf), "z", WIDTH, height(spark, sf), CELL)


@query(f"WITH {_SLOPE} SELECT cell_id, {r('slope')}, {r('aspect')} FROM terrain")
def terrain_slope_aspect(spark, sf):
    return tidied(_terrain(spark, sf).select("cell_id", "slope", "aspect"))


@query(f"""WITH {_SLOPE} SELECT land_cover, count(*) AS n, {r('avg(slope)', 'mean_slope')}, {r('max(slope)', 'max_slope')},
  {r('median(slope)', 'median_slope')}, {r('avg(aspect)', 'mean_aspect')} FROM terrain WHERE x >= 100 AND x <= 1400 GROUP BY land_cover""")
def terrain_by_cover(spark, sf):
    """The flagship: derivatives on the dense grid, the joint mask, statistics by class."""
    d = raster.joint_valid(_terrain(spark, sf), ["slope", "aspect"], F.col("x").between(100, 1400))
    return tidied(d.groupBy("land_cover").agg(F.count(F.lit(1)).alias("n"), F.avg("slope").alias("mean_slope"), F.max("slope").alias("max_slope"), F.median("slope").alias("median_slope"), F.avg("aspect").alias("mean_aspect")))


@query(f"""WITH {_PQ}, g3 AS ({_gradient_sql('p', 'col', 'r', 'g2')}), g4 AS ({_gradient_sql('p', 'row', 'pr', 'g3')}), g5 AS ({_gradient_sql('dr', 'row', 't', 'g4')}),
  k AS (SELECT *, -dr AS q, -pr AS s, p * p + dr * dr AS g FROM g5)
  SELECT cell_id, CASE WHEN sqrt(g) >= tan(radians(0.1)) THEN round(-(r * p * p + 2 * s * p * q + t * q * q) / (g * pow(1 + g, 1.5)), 6) + 0 END AS profile_curvature,
  CASE WHEN sqrt(g) >= tan(radians(0.1)) THEN round((r * q * q - 2 * s * p * q + t * p * p) / pow(g, 1.5), 6) + 0 END AS plan_curvature FROM k""")
def terrain_curvature(spark, sf):
    return tidied(raster.curvature(cells(spark, sf), "z", WIDTH, height(spark, sf), CELL).select("cell_id", "profile_curvature", "plan_curvature"))


_DISC = ", ".join(f"({a}, {b})" for a in range(-3, 4) for b in range(-3, 4) if 0 < a * a + b * b <= 9)


@query(f"""WITH {CELLS}, ok AS (SELECT row, col FROM cells WHERE land_cover <> 0), disc(dr, dc) AS (VALUES {_DISC}),
  gap AS (SELECT a.row, a.col, min(sqrt(CAST(dr * dr + dc * dc AS DOUBLE))) AS d FROM ok a, disc
    WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.row = a.row + dr AND b.col = a.col + dc) GROUP BY ALL)
  SELECT ok.row, ok.col, round(d, 6) + 0 AS distance FROM ok LEFT JOIN gap USING (row, col)""")
def edge_distance_3px(spark, sf):
    d = raster.edge_distance(cells(spark, sf), F.col("land_cover") != 0, WIDTH, height(spark, sf))
    return tidied(d.withColumn("distance", F.when(F.col("distance") < float("inf"), F.col("distance"))))


_HISTOGRAM = "SELECT land_cover AS code, count(*) AS pixels FROM cells GROUP BY land_cover"


@query(f"WITH {CELLS}, h AS ({_HISTOGRAM}) SELECT code, pixels, {r('pixels * 100.0 / (SELECT sum(pixels) FROM h)', 'percent')} FROM h")
def class_histogram(spark, sf):
    return tidied(raster.class_histogram(cells(spark, sf), "land_cover"))


@query(f"""WITH {CELLS}, h AS ({_HISTOGRAM}) SELECT CAST(c AS INTEGER) AS code, coalesce(pixels, 0) AS pixels,
  {r('coalesce(pixels, 0) * 100.0 / (SELECT sum(pixels) FROM h)', 'percent')} FROM range(0, 12) t(c) LEFT JOIN h ON h.code = c""")
def class_histogram_zero_fill(spark, sf):
    return tidied(raster.class_histogram(cells(spark, sf), "land_cover", range(0, 12)))


@query("""WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
  f AS (SELECT a.l_returnflag, b.l_linestatus, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) b LEFT JOIN n USING (l_returnflag, l_linestatus))
  SELECT *, round(CAST(n * 100.0 / sum(n) OVER (PARTITION BY l_returnflag) AS DOUBLE), 6) + 0 AS percent FROM f""")
def crosstab_zero_fill(spark, sf):
    return tidied(stats.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


_BANDS = """b AS (SELECT l_orderkey, l_linenumber, l_quantity * 100 * 0.0001::DOUBLE - 0.1::DOUBLE AS red,
  CASE WHEN l_linestatus = 'F' THEN (l_extendedprice / 10) * 0.0001::DOUBLE - 0.1::DOUBLE END AS nir FROM lineitem),
  v AS (SELECT *, (nir - red) / nullif(nir + red, 0) AS raw FROM b)"""


def _bands(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"red_dn": F.col("l_quantity") * 100, "nir_dn": F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") / 10)})
    return li.select("l_orderkey", "l_linenumber", raster.reflectance(F.col("red_dn"), 0.0001, -0.1).alias("red"), raster.reflectance(F.col("nir_dn"), 0.0001, -0.1).alias("nir"))


@query(f"WITH {_BANDS} SELECT l_orderkey, l_linenumber, CASE WHEN raw BETWEEN -1 AND 1 THEN round(raw, 6) + 0 END AS ndvi FROM v")
def reflectance_ndvi(spark, sf):
    return tidied(_bands(spark, sf).select("l_orderkey", "l_linenumber", raster.ndvi(F.col("nir"), F.col("red")).alias("ndvi")))


@query(f"WITH {_BANDS} SELECT count(*) AS n, count(*) FILTER (raw IS NULL) AS undefined, count(*) FILTER (raw NOT BETWEEN -1 AND 1) AS outside FROM v")
def ndvi_bad_denominator(spark, sf):
    raw = fn.safe_div(F.col("nir") - F.col("red"), F.col("nir") + F.col("red"))
    return _bands(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(raw.isNull()).alias("undefined"), F.count_if(~raw.between(-1, 1)).alias("outside"))


@query(f"WITH {STACK} SELECT cell, {r('median(v)', 'median')}, count(v) AS n_obs FROM stack GROUP BY cell")
def temporal_median(spark, sf):
    return tidied(raster.temporal_composite(stack(spark, sf), ["cell"], "v"))


@query(f"WITH {STACK}, c AS (SELECT cell, scene, count(v) AS n_obs FROM stack GROUP BY ALL) SELECT n_obs, count(*) AS cells FROM c GROUP BY n_obs")
def obs_count_distribution(spark, sf):
    return raster.temporal_composite(stack(spark, sf), ["cell", "scene"], "v").groupBy("n_obs").agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {CELLS} SELECT CAST(t.r AS INTEGER) AS row, CAST(u.c AS INTEGER) AS col, z AS value FROM range(0, (SELECT (max(row) + 1) // 3 FROM cells)) t(r), range(0, 16) u(c) LEFT JOIN cells ON cells.row = t.r * 3 + 1 AND cells.col = u.c * 3 + 1")
def resample_nearest(spark, sf):
    return raster.resample_nearest(cells(spark, sf), "z", 3, WIDTH // 3, height(spark, sf) // 3)


@query(f"WITH {CELLS} SELECT row // 3 AS row, col // 3 AS col, {r('avg(CASE WHEN land_cover <> 0 THEN z END)', 'value')} FROM cells GROUP BY ALL")
def resample_average(spark, sf):
    d = cells(spark, sf).withColumn("z", F.when(F.col("land_cover") != 0, F.col("z")))
    return tidied(raster.resample_average(d, "z", 3))


#: Of a fine cell the four coarse corners, as whole numbers, and their weights in sixteenths.
CORNERS = """g AS (SELECT r, c, (r + 1) // 2 - 1 AS y, (c + 1) // 2 - 1 AS x, CASE WHEN r % 2 = 0 THEN 3 ELSE 1 END AS wy, CASE WHEN c % 2 = 0 THEN 3 ELSE 1 END AS wx
    FROM range(0, (SELECT 2 * (max(row) + 1) FROM cells)) t(r), range(0, 100) u(c)),
  k AS MATERIALIZED (SELECT r, c, y AS row, x AS col, (4 - wy) * (4 - wx) AS w FROM g UNION ALL SELECT r, c, y + 1, x, wy * (4 - wx) FROM g
    UNION ALL SELECT r, c, y, x + 1, (4 - wy) * wx FROM g UNION ALL SELECT r, c, y + 1, x + 1, wy * wx FROM g)"""


@query(f"""WITH {CELLS}, land AS MATERIALIZED (SELECT row, col, z FROM cells WHERE land_cover <> 0), {CORNERS}
  SELECT CAST(k.r AS INTEGER) AS row, CAST(k.c AS INTEGER) AS col, round(sum(k.w * land.z) / sum(CASE WHEN land.z IS NOT NULL THEN k.w END), 6) + 0 AS value
  FROM k LEFT JOIN land ON k.row = land.row AND k.col = land.col GROUP BY k.r, k.c""")
def resample_bilinear(spark, sf):
    d = cells(spark, sf).withColumn("z", F.when(F.col("land_cover") != 0, F.col("z")))
    return tidied(raster.resample_bilinear(d, "z", 0.5, 2 * WIDTH, 2 * height(spark, sf)))


@query(f"""WITH {CELLS}, a AS (SELECT row, col FROM cells WHERE land_cover <> 0), b AS (SELECT row, col FROM cells WHERE z < 990 )
  SELECT count(*) FILTER (a.row IS NOT NULL AND b.row IS NOT NULL) AS both, count(*) FILTER (b.row IS NULL) AS missing, count(*) FILTER (a.row IS NULL) AS extra
  FROM a FULL JOIN b ON a.row = b.row AND a.col = b.col""")
def coverage_audit(spark, sf):
    d = cells(spark, sf)
    return raster.coverage(d.where("land_cover <> 0"), d.where("z < 990"))


@query(f"WITH {CELLS} SELECT row, min(col) AS first_col, max(col) AS last_col, count(*) AS n FROM cells WHERE land_cover <> 0 GROUP BY row")
def footprint_extremes(spark, sf):
    return cells(spark, sf).where("land_cover <> 0").groupBy("row").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS} SELECT row, col, x, y FROM cells WHERE land_cover = 0 ORDER BY row, col LIMIT 20")
def first_gaps(spark, sf):
    return cells(spark, sf).where("land_cover = 0").orderBy("row", "col").limit(20).select("row", "col", "x", "y")


# ---- vectors


def _odd_sql(rings):
    hits = [f"(CASE WHEN y >= {min(b, d)} AND y < {max(b, d)} AND x < {a}::DOUBLE + (y - {b}::DOUBLE) * {(c - a) / (d - b)!r}::DOUBLE THEN 1 ELSE 0 END)" for a, b, c, d in vector.edges(rings) if b != d]
    return f"(({' + '.join(hits)}) % 2 = 1)"


def _edge_sql(rings):
    hits = [f"((x - {a}) * ({d - b}) - (y - {b}) * ({c - a}) = 0 AND x BETWEEN {min(a, c)} AND {max(a, c)} AND y BETWEEN {min(b, d)} AND {max(b, d)})" for a, b, c, d in vector.edges(rings)]
    return f"({' OR '.join(hits)})"


def _near_sql(rings, radius):
    ds = []
    for a, b, c, d in vector.edges(rings):
        t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - {a}::DOUBLE) * {c - a}::DOUBLE + (y - {b}::DOUBLE) * {d - b}::DOUBLE) / {(c - a) ** 2 + (d - b) ** 2}::DOUBLE))"
        ds.append(f"pow(x - ({a}::DOUBLE + {t} * {c - a}::DOUBLE), 2) + pow(y - ({b}::DOUBLE + {t} * {d - b}::DOUBLE), 2)")
    return f"least({', '.join(ds)}) <= {radius * radius}"


@query(f"WITH {POINTS} SELECT event_id FROM pts WHERE {_odd_sql([OUTER])} AND NOT {_edge_sql([OUTER])}")
def pip_strict(spark, sf):
    return points(spark, sf).where(vector.within(F.col("x"), F.col("y"), [OUTER])).select("event_id")


@query(f"WITH {POINTS} SELECT event_id FROM pts WHERE {_odd_sql([OUTER])} OR {_edge_sql([OUTER])}")
def pip_inclusive(spark, sf):
    return points(spark, sf).where(vector.intersects(F.col("x"), F.col("y"), [OUTER])).select("event_id")


@query(f"WITH {POINTS} SELECT event_id FROM pts WHERE {_odd_sql([OUTER, HOLE])} AND NOT {_edge_sql([OUTER, HOLE])}")
def pip_hole(spark, sf):
    return points(spark, sf).where(vector.within(F.col("x"), F.col("y"), [OUTER, HOLE])).select("event_id")


@query(f"WITH {POINTS} SELECT event_id AS point_id, 'outer' AS polygon_id FROM pts WHERE {_odd_sql([OUTER])} AND NOT {_edge_sql([OUTER])} UNION ALL SELECT event_id, 'hole' FROM pts WHERE {_odd_sql([HOLE])} AND NOT {_edge_sql([HOLE])}")
def pip_layer(spark, sf):
    rows = [(name, *e) for name, ring in (("outer", OUTER), ("hole", HOLE)) for e in vector.edges([ring])]
    layer = spark.createDataFrame(rows, "polygon_id string, x1 double, y1 double, x2 double, y2 double")
    return vector.in_layer(points(spark, sf).withColumnRenamed("event_id", "point_id"), layer, tile=100.0)


@query(f"WITH {POINTS} SELECT event_id FROM pts WHERE {_odd_sql([OUTER])} OR {_edge_sql([OUTER])} OR {_near_sql([OUTER], 50.0)}")
def buffer_within(spark, sf):
    return points(spark, sf).where(vector.within_buffer(F.col("x"), F.col("y"), [OUTER], 50.0)).select("event_id")


_PLACED = f"{CELLS}, {POINTS}, placed AS (SELECT event_id, c.cell_id FROM pts JOIN cells c ON c.col = CAST(floor(pts.x / 30) AS INTEGER) AND c.row = CAST(floor(pts.y / 30) AS INTEGER))"


def _placed(spark, sf):
    return neighbors.points_to_cells(points(spark, sf), grid(spark, sf), cells(spark, sf))[0]


@query(f"WITH {_PLACED} SELECT cell_id, count(*) AS n FROM placed GROUP BY cell_id")
def point_to_cell_counts(spark, sf):
    return _placed(spark, sf).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PLACED} SELECT cell_id, count(*) AS n, '[' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) || ']' AS ids FROM placed GROUP BY cell_id")
def point_ids_per_cell(spark, sf):
    return neighbors.occurrences(_placed(spark, sf), "event_id")


@query(f"WITH {POINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY round_even(x / 10, 0), round_even(y / 10, 0) ORDER BY event_id) AS i FROM pts) SELECT event_id, x, y FROM n WHERE i = 1")
def lattice_dedup(spark, sf):
    return vector.lattice_dedup(points(spark, sf), "x", "y", "event_id", 10.0)


@query(f"WITH {POINTS} SELECT event_id, row_number() OVER (ORDER BY x, event_id) AS id FROM pts")
def surrogate_key(spark, sf):
    return order.numbered(points(spark, sf), "x", "id", ["event_id"]).select("event_id", "id")


@query(f"""WITH {POINTS} SELECT count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, (max(x) - min(x)) * (max(y) - min(y)) AS area,
  round(count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)), 0), 9) + 0 AS density FROM pts""")
def extent_density(spark, sf):
    return vector.extent(points(spark, sf)).withColumn("density", fn.tidy(F.col("density"), 9))


@query(f"""WITH {POINTS}, p AS (SELECT x, y FROM pts) SELECT 'rows' AS what, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT x, y FROM p)) AS BIGINT) AS duplicates FROM p
  UNION ALL SELECT 'x', count(*) - count(DISTINCT x) FROM p UNION ALL SELECT 'y', count(*) - count(DISTINCT y) FROM p""")
def inventory_audit(spark, sf):
    return contracts.duplicates(points(spark, sf).select("x", "y"), "x", "y")


def _cell_points(spark, sf):
    return cells(spark, sf).select(F.col("cell_id").alias("id"), "x", "y", "row", "col", "z", "land_cover")


_NEAREST = f"{CELLS}, {POINTS}, near AS (SELECT cell_id, min(sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2))) AS distance FROM cells c, pts p GROUP BY cell_id)"


@query(f"WITH {_NEAREST} SELECT cell_id AS id, {r('distance')} FROM near")
def nearest_distance(spark, sf):
    return tidied(neighbors.nearest_distance(_cell_points(spark, sf), points(spark, sf)))


@query(f"WITH {_NEAREST} SELECT cell_id AS id FROM near WHERE distance >= 20")
def distance_anti_join(spark, sf):
    return neighbors.distance_anti_join(_cell_points(spark, sf), points(spark, sf), 20.0).select("id")


_CANDIDATES = f"{_NEAREST}, placed AS (SELECT DISTINCT c.cell_id FROM pts JOIN cells c ON c.col = CAST(floor(pts.x / 30) AS INTEGER) AND c.row = CAST(floor(pts.y / 30) AS INTEGER)), cand AS (SELECT cell_id FROM near WHERE distance >= 15 AND cell_id NOT IN (SELECT cell_id FROM placed) AND cell_id IN (SELECT cell_id FROM cells WHERE land_cover <> 0))"


def _candidates(spark, sf):
    valid = _cell_points(spark, sf).where("land_cover <> 0")
    free = valid.join(_placed(spark, sf).select(F.col("cell_id").alias("id")), "id", "left_anti")
    return neighbors.distance_anti_join(free, points(spark, sf), 15.0)


@query(f"WITH {_CANDIDATES} SELECT cell_id FROM cand")
def background_candidates(spark, sf):
    return _candidates(spark, sf).select(F.col("id").alias("cell_id"))


@query(f"WITH {CELLS} SELECT cell_id FROM cells WHERE land_cover <> 0 ORDER BY md5('42:' || cell_id), cell_id LIMIT 100")
def sample_hash_n(spark, sf):
    return sampling.sample_ids(cells(spark, sf).where("land_cover <> 0"), "cell_id", 100, 42)


@query(f"""WITH {_CANDIDATES}, pos AS (SELECT cell_id FROM placed WHERE cell_id IN (SELECT cell_id FROM cells WHERE land_cover <> 0)),
  bg AS (SELECT cell_id FROM cand ORDER BY md5('42:' || cell_id), cell_id LIMIT 20), chosen AS (SELECT cell_id, 1 AS target FROM pos UNION ALL SELECT cell_id, 0 FROM bg)
  SELECT cell_id, target, x, y, z, land_cover FROM chosen JOIN cells USING (cell_id)""")
def sample_assembled(spark, sf):
    positives = _placed(spark, sf).select("cell_id").distinct().join(cells(spark, sf).where("land_cover <> 0").select("cell_id"), "cell_id", "left_semi")
    background = sampling.sample_ids(_candidates(spark, sf).select(F.col("id").alias("cell_id")), "cell_id", min(20, _candidates(spark, sf).limit(20).count()), 42)
    chosen = positives.withColumn("target", F.lit(1)).unionByName(background.withColumn("target", F.lit(0)))
    return chosen.join(cells(spark, sf), "cell_id").select("cell_id", "target", "x", "y", "z", "land_cover")


# ---- splits, blocks, folds


@query("""WITH n AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS t FROM customer)
  SELECT c_custkey, c_mktsegment, CASE WHEN i <= floor(t * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS split FROM n""")
def stratified_split(spark, sf):
    return sampling.stratified_split(table(spark, sf, "customer"), "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "split")


_CONFIG = sampling.SpatialConfig(folds=5, block=300.0, cell=CELL)
_BLOCKS = f"{CELLS}, blocks AS (SELECT *, CAST(floor((x - 15) / 30 / 10) AS INTEGER) AS block_x, CAST(floor((y - 15) / 30 / 10) AS INTEGER) AS block_y FROM cells), folds AS (SELECT cell_id AS id, x, y, block_x || ':' || block_y AS block_id, CAST((block_x + 2 * block_y) % 5 + 1 AS INTEGER) AS fold, CASE WHEN land_cover < 3 THEN 1 ELSE 0 END AS target FROM blocks)"


def _blocks(spark, sf):
    return sampling.blocks(_cell_points(spark, sf), _CONFIG)


def _folds(spark, sf):
    return _blocks(spark, sf).select("id", "x", "y", "block_id", ((F.col("block_x") + 2 * F.col("block_y")) % 5 + 1).alias("fold"), F.when(F.col("land_cover") < 3, 1).otherwise(0).alias("target"), "z", "land_cover")


@query(f"WITH {_BLOCKS} SELECT cell_id AS id, block_x, block_y, block_x || ':' || block_y AS block_id FROM blocks")
def block_assign(spark, sf):
    return _blocks(spark, sf).select("id", "block_x", "block_y", "block_id")


@query(f"WITH {_BLOCKS} SELECT fold, count(*) AS n, count(*) FILTER (target = 1) AS positives, count(*) FILTER (target = 0) AS negatives, count(DISTINCT block_id) AS blocks FROM folds GROUP BY fold")
def fold_class_counts(spark, sf):
    return _folds(spark, sf).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == 1).alias("positives"), F.count_if(F.col("target") == 0).alias("negatives"), F.count_distinct("block_id").alias("blocks"))


_FOLD_NEAR = f"{_BLOCKS}, near AS (SELECT v.fold AS evaluation_fold, t.id, min(sqrt(pow(t.x - v.x, 2) + pow(t.y - v.y, 2))) AS distance FROM folds t JOIN folds v ON t.fold <> v.fold GROUP BY ALL)"


@query(f"WITH {_FOLD_NEAR} SELECT id FROM near WHERE evaluation_fold = 1 AND distance >= 60")
def buffered_train(spark, sf):
    return sampling.buffered_train(_folds(spark, sf), 1, 60.0)[0].select("id")


@query(f"""WITH {_FOLD_NEAR}, f AS (SELECT DISTINCT fold FROM folds)
  SELECT f.fold AS evaluation_fold, d.id, CASE WHEN d.fold = f.fold THEN 'validation' WHEN n.distance < 60 THEN 'excluded' ELSE 'train' END AS role,
  CASE WHEN n.distance < 60 THEN round(n.distance, 6) + 0 END AS distance FROM f CROSS JOIN folds d LEFT JOIN near n ON n.evaluation_fold = f.fold AND n.id = d.id""")
def buffer_membership(spark, sf):
    d = _folds(spark, sf)
    folds = sorted(x["fold"] for x in d.select("fold").distinct().collect())
    return tidied(sampling.buffer_membership(d, folds, 60.0))


@query(f"WITH {_FOLD_NEAR} SELECT evaluation_fold, {r('min(distance)', 'distance')} FROM near GROUP BY evaluation_fold")
def fold_min_distance(spark, sf):
    d = _folds(spark, sf)
    folds = sorted(x["fold"] for x in d.select("fold").distinct().collect())
    rows = [(k, neighbors.least_distance(d.where(F.col("fold") != k), d.where(F.col("fold") == k))) for k in folds]
    return tidied(spark.createDataFrame(rows, "evaluation_fold int, distance double"))


@query()
def group_kfold(spark, sf):
    d = _folds(spark, sf).drop("fold")
    return sampling.assign_folds(d, sampling.SpatialConfig(folds=min(5, d.select("block_id").distinct().count()), block=300.0)).groupBy("fold").agg(F.count_distinct("block_id").alias("blocks"), F.count_if(F.col("target") == 1).alias("positives"), F.count_if(F.col("target") == 0).alias("negatives"))


# ---- statistics


@query("SELECT o_orderstatus, count(*) AS n, round(CAST(count(*) * 100.0 / (SELECT count(*) FROM orders) AS DOUBLE), 6) + 0 AS percent FROM orders GROUP BY o_orderstatus")
def class_distribution(spark, sf):
    return tidied(stats.distribution(table(spark, sf, "orders"), "o_orderstatus"))


_VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""WITH u AS (SELECT l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS variable, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)
  SELECT l_returnflag, variable, count(v) AS n, round(avg(v), 4) + 0 AS mean, round(stddev_samp(v), 4) + 0 AS std, round(min(v), 4) + 0 AS min, round(max(v), 4) + 0 AS max,
  round(quantile_cont(v, 0.05), 4) + 0 AS p05, round(quantile_cont(v, 0.25), 4) + 0 AS q25, round(quantile_cont(v, 0.5), 4) + 0 AS median, round(quantile_cont(v, 0.75), 4) + 0 AS q75, round(quantile_cont(v, 0.95), 4) + 0 AS p95 FROM u GROUP BY ALL""")
def describe_by_class(spark, sf):
    d = stats.long(table(spark, sf, "lineitem"), ["l_returnflag"], _VARIABLES)
    return tidied(stats.describe(d, ["l_returnflag", "variable"]), 4)


@query("""WITH d AS (SELECT event_type, radians(fmod(value * 7, 360.0::DOUBLE)) AS a FROM events), m AS (SELECT event_type, count(a) AS n, avg(sin(a)) AS s, avg(cos(a)) AS c FROM d GROUP BY event_type),
  k AS (SELECT *, least(1.0::DOUBLE, sqrt(s * s + c * c)) AS resultant FROM m)
  SELECT event_type, n, round(resultant, 6) + 0 AS resultant, CASE WHEN resultant > 1e-12 THEN round(fmod(degrees(atan2(s, c)) + 360, 360.0::DOUBLE), 6) + 0 END AS direction, round(1 - resultant, 6) + 0 AS variance FROM k""")
def circular_stats(spark, sf):
    d = table(spark, sf, "events").withColumn("a", F.pmod(F.col("value") * 7, F.lit(360.0)))
    return tidied(stats.circular(d, ["event_type"], "a"))


_TUKEY = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type),
  f AS (SELECT event_type, a - 1.5::DOUBLE * (b - a) AS low, b + 1.5::DOUBLE * (b - a) AS high FROM q), t AS (SELECT event_id, event_type, value, low, high, value < low OR value > high AS outlier FROM events JOIN f USING (event_type))"""


def _tukey(spark, sf):
    return stats.tukey(table(spark, sf, "events"), ["event_type"], "value")


@query(f"WITH {_TUKEY} SELECT event_id, event_type, {r('value')}, {r('low')}, {r('high')}, outlier FROM t")
def tukey_flags(spark, sf):
    return tidied(_tukey(spark, sf).select("event_id", "event_type", "value", "low", "high", "outlier"))


@query(f"WITH {_TUKEY} SELECT event_type, count(*) AS n, count(*) FILTER (outlier) AS outliers, {r('count(*) FILTER (outlier) * 100.0 / count(*)', 'percent')}, {r('min(low)', 'low')}, {r('min(high)', 'high')} FROM t GROUP BY event_type")
def tukey_outliers(spark, sf):
    return tidied(stats.outlier_summary(_tukey(spark, sf), ["event_type"]))


@query("SELECT c_custkey, rank() OVER (ORDER BY round(c_acctbal / 100)) + (count(*) OVER (PARTITION BY round(c_acctbal / 100)) - 1) / 2.0::DOUBLE AS rank FROM customer")
def rank_average(spark, sf):
    return order.average_rank(table(spark, sf, "customer").withColumn("v", F.round(F.col("c_acctbal") / 100)), "v").select("c_custkey", "rank")


@query("""WITH s AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
  k AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM s),
  a AS (SELECT count(*) FILTER (g = 'BUILDING') AS n1, count(*) FILTER (g = 'MACHINERY') AS n2, avg(v) FILTER (g = 'BUILDING') AS m1, avg(v) FILTER (g = 'MACHINERY') AS m2, median(v) FILTER (g = 'BUILDING') AS d1, median(v) FILTER (g = 'MACHINERY') AS d2,
    var_samp(v) FILTER (g = 'BUILDING') AS v1, var_samp(v) FILTER (g = 'MACHINERY') AS v2, sum(r) FILTER (g = 'BUILDING') AS r1 FROM k)
  SELECT n1, n2, round(m1 - m2, 6) + 0 AS mean_difference, round(d1 - d2, 6) + 0 AS median_difference, round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0)), 0), 6) + 0 AS standardised_difference,
  round(2 * (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / nullif(n1 * n2, 0) - 1, 6) + 0 AS rank_biserial FROM a""")
def two_sample_effects(spark, sf):
    return tidied(stats.two_sample(table(spark, sf, "customer"), "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal"))


def _corr_sql(source: str, variables: list[str], by: str | None) -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(f"SELECT {key}'{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) + 0 AS r FROM {source}{group}" for i, a in enumerate(variables) for b in variables[i:])


@query(_corr_sql("lineitem", _VARIABLES, "l_returnflag"))
def corr_pearson(spark, sf):
    return tidied(stats.correlations(table(spark, sf, "lineitem"), _VARIABLES, ["l_returnflag"]))


def _ranked_sql(v: str) -> str:
    return f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE AS {v}"


_PART = "p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(p_partkey % 97 AS DOUBLE) AS residue, p_retailprice * 2 + p_size AS mixed FROM part)"
_PART_VARIABLES = ["size", "price", "residue", "mixed"]


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 97).cast("double").alias("residue"), (F.col("p_retailprice") * 2 + F.col("p_size")).alias("mixed"))


@query(f"WITH {_PART}, k AS (SELECT {', '.join(map(_ranked_sql, _PART_VARIABLES))} FROM p) {_corr_sql('k', _PART_VARIABLES, None)}")
def corr_spearman(spark, sf):
    return tidied(stats.rank_correlations(_part(spark, sf), "p_partkey", _PART_VARIABLES))


@query(f"WITH {_PART}, c AS ({_corr_sql('p', _PART_VARIABLES, None)}) SELECT * FROM c WHERE a <> b AND abs(r) >= 0.8")
def corr_high_pairs(spark, sf):
    return tidied(stats.correlations(_part(spark, sf), _PART_VARIABLES)).where((F.col("a") != F.col("b")) & (F.abs("r") >= 0.8))


@query("SELECT 'l_quantity' AS a, 'l_quantity' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'l_quantity', 'one', NULL UNION ALL SELECT 'one', 'one', NULL")
def corr_constant_null(spark, sf):
    return tidied(stats.correlations(table(spark, sf, "lineitem").withColumn("one", F.lit(1.0)), ["l_quantity", "one"]))


# ---- catalogues, text


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS a, CASE WHEN event_id % 5 <> 0 THEN user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END END AS b FROM events)
  SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN NULL ELSE coalesce(a, b) END AS value, coalesce(a <> b, false) AS conflict FROM a""")
def alias_coalesce(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.expr("CASE WHEN event_id % 3 <> 0 THEN user_id END").alias("a"), F.expr("CASE WHEN event_id % 5 <> 0 THEN user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END END").alias("b"))
    value, conflict = fn.agreeing(F.col("a"), F.col("b"))
    return d.select("event_id", value.alias("value"), conflict.alias("conflict"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 6) + 0 AS value FROM events GROUP BY user_id, event_type")
def last_wins_dedup(spark, sf):
    return tidied(catalog.last_wins(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id"))


_SCENES = "s AS (SELECT 'S2_T' || (event_id % 7) || '_' || event_id AS id, ts AS taken, value AS cloud_cover FROM events)"


def _scenes(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("S2_T"), F.col("event_id") % 7, F.lit("_"), "event_id").alias("id"), F.col("ts").alias("taken"), F.when(F.col("event_id") % 11 != 0, F.col("value") / 5).alias("cloud_cover"))


@query(f"WITH {_SCENES}, d AS (SELECT *, CAST(taken AS DATE) AS date FROM s WHERE contains(id, '_T3_')), f AS (SELECT date, arg_min(id, taken) AS id FROM d GROUP BY date) SELECT id, CAST(date AS VARCHAR) AS date FROM f")
def scene_select(spark, sf):
    scenes = _scenes(spark, sf).where(F.col("id").contains("_T3_")).withColumn("date", F.to_date("taken").cast("string"))
    first = scenes.groupBy("date").agg(F.min_by("id", "taken").alias("id"))
    dates = [x["date"] for x in first.select("date").collect()]
    return catalog.select_scenes(scenes.join(first, ["date", "id"], "left_semi").drop("date"), dates, "T3").select("id", F.col("date").cast("string").alias("date"))


@query("""WITH s AS (SELECT CASE WHEN event_id % 11 <> 0 THEN value / 5 END AS c FROM events) SELECT count(*) AS items, count(*) FILTER (c IS NULL) AS unknown, round(min(c), 6) + 0 AS min, round(max(c), 6) + 0 AS max, round(avg(c), 6) + 0 AS mean,
  count(*) FILTER (c <= 10) AS upto_10, count(*) FILTER (c <= 20) AS upto_20, count(*) FILTER (c <= 30) AS upto_30 FROM s""")
def cloud_threshold_counts(spark, sf):
    return tidied(catalog.cover_counts(_scenes(spark, sf), "cloud_cover"))


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(trim(n_name)) = 'brazil' OR n_nationkey = 3")
def string_clean_match(spark, sf):
    messy = table(spark, sf, "nation").withColumn("messy", F.concat(F.lit(" \t"), F.initcap("n_name"), F.lit("\n ")))
    return messy.where(fn.same_text(F.col("messy"), " BRAZIL ") | (F.col("n_nationkey") == 3)).select("n_nationkey", "n_name")


@query("SELECT c_custkey, printf('sample_%06d', c_custkey * 1000) AS id FROM customer")
def zero_pad_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.padded_id("sample_", F.col("c_custkey") * 1000).alias("id"))


@query("SELECT s_suppkey, (CASE WHEN a >= 0 THEN 'N' ELSE 'S' END) || printf('%02d', abs(a)) || (CASE WHEN b >= 0 THEN 'E' ELSE 'W' END) || printf('%03d', abs(b)) AS tile FROM (SELECT s_suppkey, CAST(s_suppkey % 91 - 45 AS INTEGER) AS a, CAST(s_suppkey * 7 % 359 - 179 AS INTEGER) AS b FROM supplier)")
def tile_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", fn.tile_name(F.col("s_suppkey") % 91 - 45, F.col("s_suppkey") * 7 % 359 - 179).alias("tile"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS scheme, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^[a-zA-Z]+://[A-Za-z0-9.-]+(/[A-Za-z0-9/._-]*)?$')")
def url_parts(spark, sf):
    plain = table(spark, sf, "pages").where(F.col("url").rlike(r"^[a-zA-Z]+://[A-Za-z0-9.-]+(/[A-Za-z0-9/._-]*)?$"))
    return plain.select("page_id", F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


# ---- metrics

_CONFUSION = """count(*) FILTER (p < 0.5 AND y <> 1) AS tn, count(*) FILTER (p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p >= 0.5 AND y = 1) AS tp"""
_RATES = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) + 0 AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) + 0 AS balanced_accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0 AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0 AS f1"""


@query(f"WITH {SCORED}, c AS (SELECT {_CONFUSION} FROM scored) SELECT tn, fp, fn, tp, {_RATES} FROM c")
def confusion_metrics(spark, sf):
    return tidied(metrics.confusion(scored(spark, sf)))


_CURVE = f"""{SCORED}, t AS (SELECT p, count(*) AS m, count(*) FILTER (y = 1) AS k FROM scored GROUP BY p), c AS (SELECT *, sum(m) OVER w AS n, sum(k) OVER w AS tp FROM t WINDOW w AS (ORDER BY p DESC)),
  z AS (SELECT sum(k) AS pos, sum(m - k) AS neg FROM t), d AS (SELECT *, tp / n AS pr, lag(tp / n, 1, 1.0::DOUBLE) OVER (ORDER BY p DESC) AS pr0, n - tp AS fp, lag(n - tp, 1, 0) OVER (ORDER BY p DESC) AS fp0, lag(tp, 1, 0) OVER (ORDER BY p DESC) AS tp0 FROM c)"""


@query(f"WITH {_CURVE} SELECT round(sum((fp - fp0) * (tp + tp0) / 2) / (SELECT pos * neg FROM z), 6) + 0 AS roc_auc FROM d")
def roc_auc(spark, sf):
    return tidied(metrics.curve_metrics(scored(spark, sf)).select("roc_auc"))


@query(f"WITH {_CURVE} SELECT round(sum(k * (pr + pr0) / 2) / (SELECT pos FROM z), 6) + 0 AS pr_auc FROM d")
def pr_auc_trap(spark, sf):
    return tidied(metrics.curve_metrics(scored(spark, sf)).select("pr_auc"))


@query(f"WITH {_CURVE} SELECT round(sum(k * pr) / (SELECT pos FROM z), 6) + 0 AS average_precision FROM d")
def average_precision(spark, sf):
    return tidied(metrics.curve_metrics(scored(spark, sf)).select("average_precision"))


@query(f"WITH {_CURVE} SELECT p AS score, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp FROM d")
def roc_points(spark, sf):
    return metrics.roc_points(scored(spark, sf))


@query(f"WITH {SCORED} SELECT doc_id, p, round(row_number() OVER (ORDER BY p, doc_id) / count(*) OVER (), 6) + 0 AS ecdf FROM scored")
def ecdf(spark, sf):
    return tidied(metrics.ecdf(scored(spark, sf).select("doc_id", "p"), "p", ["doc_id"]))


_FOLDED = f"""{SCORED}, m AS (SELECT 'a' AS model, doc_id % 5 AS fold, y, p FROM scored UNION ALL SELECT 'b', doc_id % 5, y, 1 - p FROM scored), c AS (SELECT model, fold, {_CONFUSION} FROM m GROUP BY ALL), f AS (SELECT model, fold, {_RATES} FROM c)"""


def _folded(spark, sf):
    d = scored(spark, sf).withColumn("fold", F.col("doc_id") % 5)
    both = d.withColumn("model", F.lit("a")).unionByName(d.withColumns({"model": F.lit("b"), "p": 1 - F.col("p")}))
    return tidied(metrics.confusion(both, ["model", "fold"]))


@query(f"""WITH {_FOLDED}, u AS (SELECT model, unnest(['accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([accuracy, balanced_accuracy, precision, recall, f1]) AS v FROM f)
  SELECT model, metric, round(avg(v), 5) + 0 AS mean, round(stddev_samp(v), 5) + 0 AS std, round(min(v), 5) + 0 AS min, round(max(v), 5) + 0 AS max FROM u GROUP BY ALL""")
def fold_metric_summary(spark, sf):
    return tidied(metrics.fold_summary(_folded(spark, sf), ["model"], metrics.METRICS), 5)


@query(f"""WITH {_FOLDED}, l AS (SELECT * FROM f WHERE model = 'a' AND fold <> 0), r AS (SELECT * FROM f WHERE model = 'b' AND fold <> 4)
  SELECT coalesce(l.fold, r.fold) AS fold, l.accuracy AS accuracy_left, r.accuracy AS accuracy_right, CASE WHEN r.fold IS NULL THEN 'left_only' WHEN l.fold IS NULL THEN 'right_only' ELSE 'both' END AS side, round(r.accuracy - l.accuracy, 6) + 0 AS accuracy_delta FROM l FULL JOIN r ON l.fold = r.fold""")
def metric_compare_outer(spark, sf):
    f = _folded(spark, sf)
    return tidied(metrics.compare(f.where("model = 'a' AND fold <> 0"), f.where("model = 'b' AND fold <> 4"), ["fold"], ["accuracy"]))


@query(f"""WITH {SCORED} SELECT y, count(p) AS n, min(p) AS min, max(p) AS max, round(avg(p), 6) + 0 AS mean, count(*) FILTER (p < 0 OR p > 1) AS outside, round(quantile_cont(p, 0.05), 6) + 0 AS p05, round(quantile_cont(p, 0.25), 6) + 0 AS p25,
  round(quantile_cont(p, 0.5), 6) + 0 AS median, round(quantile_cont(p, 0.75), 6) + 0 AS p75, round(quantile_cont(p, 0.95), 6) + 0 AS p95 FROM scored GROUP BY y""")
def score_distribution(spark, sf):
    return tidied(metrics.score_distribution(scored(spark, sf), "p", ["y"]))


_TWO = f"{SCORED}, t AS (SELECT doc_id, p AS a, round(p * p, 6) AS b FROM scored)"


def _two(spark, sf):
    return scored(spark, sf).select("doc_id", F.col("p").alias("a"), F.round(F.col("p") * F.col("p"), 6).alias("b"))


@query(f"""WITH {_TWO} SELECT count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) + 0 AS pearson, round(avg(abs(a - b)), 6) + 0 AS mae, round(sqrt(avg((a - b) * (a - b))), 6) + 0 AS rmse,
  round(avg(a - b), 6) + 0 AS mean_signed, round(min(a - b), 6) + 0 AS min_signed, round(max(a - b), 6) + 0 AS max_signed FROM t""")
def surface_agreement(spark, sf):
    return tidied(metrics.agreement(_two(spark, sf), "a", "b"))


@query(f"WITH {_TWO} SELECT doc_id, a, b, round((a + b) / 2, 8) + 0 AS ensemble FROM t")
def ensemble_mean(spark, sf):
    return tidied(ml.ensemble(_two(spark, sf), "a", "b"), 8)


@query(f"WITH {CELLS} SELECT CAST((cell_id * 3) % 11 AS INTEGER) AS code, count(*) AS n FROM cells WHERE (cell_id * 3) % 11 NOT IN (SELECT land_cover FROM cells) GROUP BY 1")
def unknown_categories(spark, sf):
    d = cells(spark, sf)
    other = d.select(((F.col("cell_id") * 3) % 11).cast("int").alias("code"))
    return other.join(d.select(F.col("land_cover").alias("code")).distinct(), "code", "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---- contracts, provenance, models


@query(f"""WITH {CELLS}, v AS (SELECT CASE WHEN land_cover = 0 THEN NULL WHEN land_cover = 1 THEN -9999 ELSE z END AS z, land_cover FROM cells)
  SELECT 'null z' AS rule, count(*) FILTER (z IS NULL) AS violations FROM v UNION ALL SELECT 'infinite z', 0 FROM (SELECT 1) UNION ALL SELECT 'no data z', count(*) FILTER (z = -9999) FROM v
  UNION ALL SELECT 'whole land_cover', 0 FROM (SELECT 1) UNION ALL SELECT 'range land_cover', count(*) FILTER (land_cover < 0 OR land_cover >= 6) FROM v""")
def dataset_qa(spark, sf):
    d = cells(spark, sf).withColumn("z", F.when(F.col("land_cover") == 0, F.lit(None)).when(F.col("land_cover") == 1, contracts.NODATA).otherwise(F.col("z")))
    return contracts.violations(d, contracts.qa_rules(["z"], ["land_cover"], {"land_cover": (0, 6)}))


@query(f"""WITH {CELLS} SELECT 'finite z' AS rule, count(*) FILTER (land_cover = 2) AS violations FROM cells UNION ALL SELECT 'finite x', 0 UNION ALL SELECT 'target', count(*) FILTER (land_cover > 1) FROM cells
  UNION ALL SELECT 'bounds x', count(*) FILTER (NOT x BETWEEN 100 AND 1000) FROM cells""")
def feature_contract(spark, sf):
    d = cells(spark, sf).withColumns({"z": F.when(F.col("land_cover") != 2, F.col("z")), "target": F.col("land_cover")})
    return contracts.violations(d, contracts.feature_rules(["z", "x"], bounds={"x": (100, 1000)}))


@query(f"WITH {CELLS} SELECT 'keys' AS column, count(*) FILTER (cell_id % 13 = 0) AS differences FROM cells UNION ALL SELECT 'z', count(*) FILTER (cell_id % 13 <> 0 AND cell_id % 5 = 0) FROM cells UNION ALL SELECT 'land_cover', 0")
def table_equality(spark, sf):
    d = cells(spark, sf).select("cell_id", "z", "land_cover")
    return contracts.table_differences(d, d.where("cell_id % 13 <> 0").withColumn("z", F.when(F.col("cell_id") % 5 == 0, F.col("z") + 1).otherwise(F.col("z") * (1 + 1e-15))), ["cell_id"])


@query()
def manifest_sha256(spark, sf):
    return provenance.manifest(spark, f"{sf}/region.parquet", f"{sf}/nation.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes", "sha256", "md5")


def _model_table(spark, sf):
    return _folds(spark, sf).withColumn("target", F.expr("CASE WHEN z + id % 7 * 10 > 980 THEN 1 ELSE 0 END"))


@query()
def lr_fit_score(spark, sf):
    d = _model_table(spark, sf)
    return metrics.curve_metrics(ml.fit(d, "logistic", ["z", "x", "y"], "land_cover").scores(d).withColumnRenamed("target", "t").withColumn("p", F.round("p", 9)), y="t")


@query()
def rf_fit_score(spark, sf):
    d = _model_table(spark, sf)
    return metrics.curve_metrics(ml.fit(d, "forest", ["z", "x", "y"], "land_cover").scores(d), y="target")


@query()
def spatial_cv(spark, sf):
    d = _model_table(spark, sf)
    got = ml.cross_validate(d, sorted(x["fold"] for x in d.select("fold").distinct().collect()), "logistic", ["z", "x", "y"], "land_cover")
    return metrics.confusion(got, ["fold"], y="target")


@query()
def spatial_cv_buffered(spark, sf):
    """The same frozen folds, with training rows only that are 60 m or more from all validation rows."""
    d = _model_table(spark, sf)
    folds = sorted(x["fold"] for x in d.select("fold").distinct().collect())
    got = ml.cross_validate(d, folds, "logistic", ["z", "x", "y"], "land_cover", train=lambda k: sampling.buffered_train(d, k, 60.0)[0])
    return metrics.confusion(got, ["fold"], y="target")


@query()
def holdout_metrics(spark, sf):
    d = sampling.stratified_split(_model_table(spark, sf), "target", "id")
    return tidied(ml.holdout(d, "logistic", ["z", "x", "y"], "land_cover")[1])
