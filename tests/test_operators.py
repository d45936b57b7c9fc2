"""Operators against hand-computed values and independent NumPy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell import functions as fn
from terracell.grid import GridSpec
from terracell.operators import catalog, contracts, metrics, ml, neighbors, order, raster, sampling, stats, vector


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def surface(spark, z):
    h, w = z.shape
    return spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(h) for c in range(w)], "row int, col int, z double")


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", name).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def test_gradient_equals_numpy_with_holes(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(7, 9)) * 50
    z[3, 4] = z[0, 0] = np.nan
    d = raster.gradient(surface(spark, z), "z", "row", 7, 30.0, "dr")
    d = raster.gradient(d, "z", "col", 9, 30.0, "dc")
    dr, dc = np.gradient(z, 30.0)
    np.testing.assert_allclose(dense(d, "dr", z.shape), dr, atol=1e-12)
    np.testing.assert_allclose(dense(d, "dc", z.shape), dc, atol=1e-12)


def test_plane_slope_aspect_and_curvature(spark):
    r, c = np.indices((20, 20))
    z = 2.0 * c * 30 + 3.0 * (19 - r) * 30 + 100
    d = raster.slope_aspect(surface(spark, z), "z", 20, 20, 30.0)
    np.testing.assert_allclose(dense(d, "slope", z.shape), math.degrees(math.atan(math.sqrt(13))))
    np.testing.assert_allclose(dense(d, "aspect", z.shape), (math.degrees(math.atan2(-2, -3)) + 360) % 360)
    k = raster.curvature(surface(spark, z), "z", 20, 20, 30.0)
    assert np.nanmax(np.abs(dense(k, "profile_curvature", z.shape))) < 1e-10
    assert np.nanmax(np.abs(dense(k, "plan_curvature", z.shape))) < 1e-10


@pytest.mark.parametrize("degrees, undefined", [(0.05, 400), (0.11, 0)])
def test_curvature_needs_a_slope(spark, degrees, undefined):
    _, c = np.indices((20, 20))
    k = raster.curvature(surface(spark, c * 30 * math.tan(math.radians(degrees))), "z", 20, 20, 30.0)
    assert k.where("profile_curvature IS NULL").count() == undefined


def test_paraboloid_is_curved_and_flat_faces_north(spark):
    r, c = np.indices((21, 21))
    k = raster.curvature(surface(spark, ((r - 10.0) ** 2 + (c - 10.0) ** 2) * 9), "z", 21, 21, 30.0)
    assert k.where("abs(profile_curvature) > 1e-9").count() > 300
    flat = raster.slope_aspect(surface(spark, np.ones((4, 4))), "z", 4, 4, 30.0)
    assert rows(flat, "slope", "aspect") == [(0.0, 0.0)] * 16


def test_joint_mask_drops_each_defect(spark):
    bad = [(False, 1.0), (True, None), (True, float("nan")), (True, float("inf")), (True, -9999.0)]
    d = spark.createDataFrame([(i, *b) for i, b in enumerate(bad)] + [(9, True, 5.0)], "i int, inside boolean, z double")
    d = d.withColumn("z", fn.valid(F.col("z"), -9999.0))
    assert rows(raster.joint_valid(d, ["z"], F.col("inside")), "i") == [(9,)]


def test_ndvi_and_reflectance(spark):
    d = spark.createDataFrame([(0.8, 0.2), (0.0, 0.0), (0.5, -0.2), (None, 0.1)], "nir double, red double")
    assert [r[0] for r in d.select(raster.ndvi(F.col("nir"), F.col("red"))).collect()] == [pytest.approx(0.6), None, None, None]
    d = spark.createDataFrame([(0.0,), (1000.0,), (float("nan"),)], "dn double")
    assert [r[0] for r in d.select(raster.reflectance(F.col("dn"), 0.0001, -0.1)).collect()] == [None, pytest.approx(0.0), None]


def test_edge_distance_by_brute_force(spark):
    rng = np.random.default_rng(3)
    ok = rng.random((9, 11)) > 0.15
    d = spark.createDataFrame([(r, c, bool(ok[r, c])) for r in range(9) for c in range(11)], "row int, col int, ok boolean")
    got = {(r["row"], r["col"]): r["distance"] for r in raster.edge_distance(d, F.col("ok"), 11, 9).collect()}
    gaps = [(r, c) for r in range(-4, 13) for c in range(-4, 15) if not (0 <= r < 9 and 0 <= c < 11 and ok[r, c])]
    for (r, c), x in got.items():
        want = min(math.hypot(r - a, c - b) for a, b in gaps)
        assert x == (pytest.approx(want) if want <= 3 else math.inf)


def test_polygons(spark):
    box = [[(15.0, 0.0), (180.0, 0.0), (180.0, 150.0), (15.0, 150.0), (15.0, 0.0)]]
    hole = [[(60.0, 60.0), (90.0, 60.0), (90.0, 90.0), (60.0, 90.0), (60.0, 60.0)]]
    d = spark.createDataFrame([(0, 15.0, 75.0), (1, 45.0, 75.0), (2, 75.0, 75.0), (3, 60.0, 75.0), (4, 200.0, 75.0), (5, 185.0, 75.0)], "point_id long, x double, y double")
    ids = lambda c: [r[0] for r in d.where(c).orderBy("point_id").collect()]
    x, y = F.col("x"), F.col("y")
    assert ids(vector.within(x, y, box)) == [1, 2, 3]
    assert ids(vector.intersects(x, y, box)) == [0, 1, 2, 3]
    assert ids(vector.within(x, y, box + hole)) == [1]
    assert ids(vector.intersects(x, y, box + hole)) == [0, 1, 3]
    assert ids(vector.within_buffer(x, y, box, 5.0)) == [0, 1, 2, 3, 5]
    layer = spark.createDataFrame([("p", *e) for e in vector.edges(box + hole)], "polygon_id string, x1 double, y1 double, x2 double, y2 double")
    assert rows(vector.in_layer(d, layer, tile=40.0), "point_id") == [(1,)]
    assert rows(vector.in_layer(d, layer, inclusive=True, tile=40.0), "point_id") == [(0,), (1,), (3,)]
    with pytest.raises(ValueError):
        vector.edges([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]])


def test_projection_near_a_known_point(spark):
    d = spark.createDataFrame([(-51.0, 0.0), (-51.0, -30.0)], "lon double, lat double")
    e, n = vector.transverse_mercator(F.col("lon"), F.col("lat"))
    got = d.select(e.alias("e"), n.alias("n")).collect()
    assert got[0]["e"] == pytest.approx(500000) and got[0]["n"] == pytest.approx(10_000_000)
    assert got[1]["n"] == pytest.approx(10_000_000 - 0.9996 * 3320113.398, abs=0.01)


def test_exact_distance_keeps_the_point(spark):
    cells = spark.createDataFrame([(0, 15.0, 15.0), (1, 45.0, 15.0), (2, 75.0, 15.0)], "id long, x double, y double")
    point = spark.createDataFrame([(15.0, 15.0)], "x double, y double")
    free = lambda radius: [r[0] for r in rows(neighbors.distance_anti_join(cells.where("id > 0"), point, radius), "id")]
    assert (free(30.0), free(30.01), free(0.0)) == ([1, 2], [2], [1, 2])


def test_nearest_distance_by_brute_force(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random((60, 2)) * 1000, rng.random((25, 2)) * 1000
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id long, x double, y double")
    right = spark.createDataFrame([tuple(map(float, p)) for p in b], "x double, y double")
    got = {r["id"]: r["distance"] for r in neighbors.nearest_distance(left, right).collect()}
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min(1)
    np.testing.assert_allclose([got[i] for i in range(60)], want)
    assert neighbors.least_distance(left, right) == pytest.approx(want.min())
    assert neighbors.nearest_distance(left, right.limit(0)).where("distance IS NULL").count() == 60


def test_nearest_distance_of_crowds_and_far_rows(spark):
    rng = np.random.default_rng(9)
    b = np.concatenate((rng.normal(0, 1e-3, (3000, 2)), rng.random((40, 2)) * 1e5, [[7.0, 7.0]] * 5))
    a = np.concatenate((rng.normal(0, 1e-3, (20, 2)), rng.random((60, 2)) * 3e5 - 1e5, b[:3]))
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "id long, x double, y double")
    right = spark.createDataFrame([tuple(map(float, p)) for p in b] + [(None, 1.0)], "x double, y double")
    got = {r["id"]: r["distance"] for r in neighbors.nearest_distance(left, right).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(a))], np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min(1))
    assert got[900] is None and got[901] is None
    one = neighbors.nearest_distance(left, right.where("x = 7")).where("id = 0").first()["distance"]
    assert one == pytest.approx(float(np.hypot(*(a[0] - 7))))


@pytest.mark.parametrize("radius", [-1.0, float("nan"), float("inf")])
def test_radius_must_be_finite(spark, radius):
    d = spark.createDataFrame([(1, 1.0, 1.0)], "id long, x double, y double")
    for call in (neighbors.closer_than, neighbors.distance_anti_join, neighbors.min_distance_within):
        with pytest.raises(ValueError):
            call(d, d, radius)


def test_points_to_keep_away_from_must_be_there(spark):
    d = spark.createDataFrame([(1, 1.0, 1.0)], "id long, x double, y double")
    for right in (d.limit(0), d.withColumn("x", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            neighbors.distance_anti_join(d, right, 1.0)


def test_folds_need_rows_of_both_classes(spark):
    d = spark.createDataFrame([(i, f"b{i}", int(i < 2)) for i in range(20)], "id long, block_id string, target int")
    with pytest.raises(ValueError):
        sampling.assign_folds(d, sampling.SpatialConfig(folds=3))
    faults = d.withColumn("fold", F.lit(1)).agg(sampling.partition_faults(d, 3)).first()[0]
    assert faults["missing_folds"] == 2 and faults["unknown_fold"] == 0


def test_model_is_saved_and_loaded_by_its_digest(spark, tmp_path):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, float(x), int(i % 3), int(x + rng.normal() * 0.5 > 0)) for i, x in enumerate(rng.normal(size=160))], "id long, z double, code int, target int")
    fitted, scores = ml.holdout(sampling.stratified_split(d, "target", "id"), "logistic", ["z"], "code")
    got = {r["split"]: r for r in scores.collect()}
    assert set(got) == {"train", "test"} and got["test"]["roc_auc"] > 0.8
    sha = ml.save(fitted, tmp_path / "m")
    again = ml.load(tmp_path / "m", sha)
    assert rows(again.scores(d), "id", "p") == rows(fitted.scores(d), "id", "p")
    (tmp_path / "m" / "classifier.json").write_text("{}")
    with pytest.raises(ValueError):
        ml.load(tmp_path / "m", sha)


def test_points_to_cells_and_occurrences(spark):
    g = GridSpec(0.0, 150.0, 30.0, -30.0, 6, 5)
    mask = g.dense(spark).where("cell_id <> 29")
    d = spark.createDataFrame([(9, 14.0, 136.0), (2, 16.0, 134.0), (7, 75.0, 75.0), (1, -1.0, 135.0)], "id long, x double, y double")
    inside, outside = neighbors.points_to_cells(d, g, mask)
    assert rows(neighbors.occurrences(inside, "id"), "cell_id", "n", "ids") == [(0, 2, "[2,9]"), (14, 1, "[7]")]
    assert outside.count() <= 1


def test_sampling(spark):
    d = spark.range(100).withColumnRenamed("id", "cell_id")
    a = rows(sampling.sample_ids(d, "cell_id", 30, 7), "cell_id")
    assert a == rows(sampling.sample_ids(d.orderBy(F.desc("cell_id")), "cell_id", 30, 7), "cell_id") and len(set(a)) == 30
    assert a != rows(sampling.sample_ids(d, "cell_id", 30, 8), "cell_id")
    with pytest.raises(ValueError):
        sampling.sample_ids(d, "cell_id", 101, 7)
    exact = sampling.sample_exact(list(range(99, -1, -1)), 30, 42)
    assert exact == sampling.sample_exact(list(range(100)), 30, 42) and len(set(exact)) == 30


def test_stratified_split_is_exact(spark):
    d = spark.range(160).select("id", (F.col("id") % 2).alias("target"))
    s = sampling.stratified_split(d, "target", "id")
    assert rows(s.groupBy("target", "split").count(), "target", "split", "count") == [(0, "test", 20), (0, "train", 60), (1, "test", 20), (1, "train", 60)]


def test_buffer_boundary_and_membership(spark):
    d = spark.createDataFrame([(0, 0.0, 0.0, 1), (1, 30.0, 0.0, 1), (2, 299.9, 0.0, 2), (3, 330.0, 0.0, 2), (4, 0.0, 300.0, 2), (5, 0.0, 299.0, 2), (6, 900.0, 0.0, 2)], "id long, x double, y double, fold int")
    kept, gone = sampling.buffered_train(d, 1, 300.0)
    assert (rows(kept, "id"), rows(gone, "id")) == ([(3,), (4,), (6,)], [(2,), (5,)])
    m = sampling.buffer_membership(d, [1, 2], 300.0)
    assert m.count() == 14 and rows(m.where("evaluation_fold = 1 AND role = 'excluded'"), "id") == [(2,), (5,)]


def test_blocks_and_folds(spark):
    cfg = sampling.SpatialConfig(folds=3, block=60.0)
    d = spark.createDataFrame([(r * 10 + c, c * 30.0 + 15, r * 30.0 + 15, (r + c) % 2) for r in range(10) for c in range(10)], "id long, x double, y double, target int")
    b = sampling.blocks(d, cfg)
    assert b.select("block_id").distinct().count() == 25 and rows(b.where("id = 11"), "block_id") == [("0:0",)]
    f = sampling.assign_folds(b, cfg)
    faults = f.select(sampling.partition_faults(f, 3).alias("f")).first()["f"]
    assert all(v == 0 for v in faults.asDict().values()) and f.select("fold").distinct().count() == 3
    assert sampling.off_grid(d, cfg).count() == 0 and sampling.off_grid(d.withColumn("x", F.when(F.col("id") == 5, F.col("x") + 1).otherwise(F.col("x"))), cfg).count() == 1
    for bad in ({"folds": 1}, {"block": 50.0}):
        with pytest.raises(ValueError):
            sampling.SpatialConfig(**bad)


def test_describe_two_classes(spark):
    d = spark.createDataFrame([("a" if i < 270 else "b", float(100 + i)) for i in range(540)], "sample_type string, value double")
    a = stats.describe(d, ["sample_type"]).where("sample_type = 'a'").first()
    assert (a["min"], a["max"], a["mean"], a["median"]) == (100.0, 369.0, 234.5, 234.5)
    two = stats.two_sample(d, "sample_type", "a", "b", "value").first()
    assert two["mean_difference"] == -270 and two["rank_biserial"] == -1


def test_circular_mean(spark):
    d = spark.createDataFrame([("seam", 359.0), ("seam", 1.0)] + [("round", x) for x in (0.0, 90.0, 180.0, 270.0)], "g string, a double")
    got = {r["g"]: r["direction"] for r in stats.circular(d, ["g"], "a").collect()}
    assert got["seam"] == pytest.approx(0.0, abs=1e-9) and got["round"] is None


def test_tukey_flags_strictly(spark):
    d = stats.tukey(spark.createDataFrame([("g", float(x)) for x in (0, 0, 0, 0, 5)], "g string, v double"), ["g"], "v")
    assert rows(d.where("outlier"), "v", "low", "high") == [(5.0, 0.0, 0.0)]


def test_ranks_numbers_and_correlations(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 40, 500)
    d = spark.createDataFrame([(i, float(x), float(x) ** 3 + 1) for i, x in enumerate(v)], "i int, v double, w double")
    got = {r["i"]: r["rank"] for r in order.average_rank(d, "v").collect()}
    want = [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]
    assert [got[i] for i in range(500)] == want
    assert sorted(r["n"] for r in order.numbered(d, "v", "n", ["i"]).collect()) == list(range(1, 501))
    r = {(x["a"], x["b"]): x["r"] for x in stats.rank_correlations(d, "i", ["v", "w"]).collect()}
    assert r["v", "w"] == pytest.approx(1.0)
    c = stats.correlations(d.withColumn("one", F.lit(2.0)), ["v", "one"]).where("a = 'v' AND b = 'one'").first()
    assert c["r"] is None


def test_metrics_by_hand(spark):
    d = spark.createDataFrame([(0, 0.1), (0, 0.8), (1, 0.4), (1, 0.9)], "y int, p double")
    m, c = metrics.confusion(d).first(), metrics.curve_metrics(d).first()
    assert [m[k] for k in ("tn", "fp", "fn", "tp")] == [1, 1, 1, 1] and all(m[k] == 0.5 for k in metrics.METRICS)
    assert c["roc_auc"] == 0.75 and c["pr_auc"] == pytest.approx(19 / 24) and c["average_precision"] == pytest.approx(5 / 6)
    none = metrics.confusion(d.withColumn("p", F.lit(0.0))).first()
    assert none["precision"] == none["recall"] == none["f1"] == 0
    assert metrics.curve_metrics(d.where("y = 1")).first()["roc_auc"] is None
    tie = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.2)], "y int, p double")
    assert metrics.curve_metrics(tie).first()["roc_auc"] == pytest.approx(0.25)
    f = metrics.probability_faults()
    assert d.select(f.alias("f")).first()["f"].asDict() == {"bad_class": 0, "bad_probability": 0, "one_class": 0}


def test_surfaces(spark):
    d = spark.createDataFrame([(0.0, 0.0), (0.5, 0.25), (1.0, 0.75)], "a double, b double")
    r = metrics.agreement(d, "a", "b").first()
    assert r["mae"] == pytest.approx(1 / 6) and r["rmse"] == pytest.approx(math.sqrt(0.125 / 3)) and r["mean_signed"] == pytest.approx(1 / 6)


def test_contracts(spark):
    d = spark.createDataFrame([(1.0, 0), (None, 1)], "z double, target int")
    with pytest.raises(contracts.ContractError) as e:
        contracts.require(d, contracts.feature_rules(["z"]))
    assert e.value.broken == {"finite z": 1}
    contracts.require(d.where("target = 0"), contracts.feature_rules(["z"]))
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(d, ["target", "z"], exact=True)
    with pytest.raises(contracts.ContractError):
        contracts.require_balanced(d, "target")


def test_catalogue(spark):
    page = '{"features":[{"id":"S2_T22JDN_1","collection":"l2a","properties":{"start_datetime":"2024-03-02T10:00:00Z","eo:cloud_cover":"7.5"},"assets":{"B04":{"href":"s3://bucket/a.jp2","alternate":{"https":{"href":"https://h/a.jp2?x=1"}}}}}]}'
    pages = spark.createDataFrame([(0, page), (1, page)], "page int, json string")
    every = catalog.items(pages)
    one = catalog.last_wins(every, ["collection", "id"], "page")
    flat = catalog.flatten(one).first()
    assert every.count() == 2 and one.count() == 1 and flat["cloud_cover"] == 7.5 and flat["n_assets"] == 1
    assert rows(catalog.asset_paths(one), "scheme", "host", "path") == [("s3", "bucket", "/a.jp2")]
    assert catalog.select_scenes(catalog.flatten(one), ["2024-03-02"], "T22JDN").count() == 1
    with pytest.raises(ValueError):
        catalog.select_scenes(catalog.flatten(one), ["2024-03-03"], "T22JDN")


def test_text_functions(spark):
    d = spark.createDataFrame([("\t Porto Alegre \n", 1234567)], "name string, n long")
    assert d.where(fn.same_text(F.col("name"), "porto alegre")).count() == 1
    assert d.select(fn.padded_id("sample_", F.col("n"))).first()[0] == "sample_1234567"
    assert spark.range(1).select(fn.tile_name(F.lit(-31), F.lit(-52))).first()[0] == "S31W052"


def test_model_handles_unseen_categories_and_scales_by_population(spark):
    rng = np.random.default_rng(5)
    data = [(i, float(x), int(k), int(x + rng.normal() > 0)) for i, (x, k) in enumerate(zip(rng.normal(size=160), rng.integers(1, 4, 160)))]
    d = spark.createDataFrame(data, "id int, x double, code int, target int")
    scaler = ml.Scaler(d, ["x"])
    assert scaler.of["x"][1] == pytest.approx(np.std([r[1] for r in data]))
    m = ml.fit(d, "logistic", ["x"], "code")
    new = spark.createDataFrame([(0, 0.0, 99, 0)], "id int, x double, code int, target int")
    assert 0 < m.scores(new).first()["p"] < 1 and rows(m.unknown(new), "code", "n") == [(99, 1)]
    assert m.importances()[0][0] == "x"
