"""The supervised table on a small grid, and what its audit catches."""

import pytest
from pyspark.sql import functions as F

from terracell.grid import GridSpec
from terracell.operators import ml, raster
from terracell.operators.contracts import ContractError
from terracell.plans import dataset


@pytest.fixture(scope="module")
def inputs(spark):
    g = GridSpec(0.0, 150.0, 30.0, -30.0, 6, 5)
    cells = g.dense(spark).select("cell_id", "row", "col", (F.col("cell_id") != 29).alias("inside"), F.lit(100.0).alias("z"), (F.col("cell_id") % 4 * 90.0).alias("a"), F.when(F.col("col") % 2 == 1, 9).otherwise(3).alias("cover"))
    points = spark.createDataFrame([(9, 14.0, 136.0), (2, 16.0, 134.0), (7, 75.0, 75.0)], "id long, x double, y double")
    exclusion = points.select("x", "y").union(spark.createDataFrame([(-1.0, 135.0)], "x double, y double"))
    return dataset.Inputs(g, cells, points, exclusion, ["z", "a"], "cover")


def test_assemble_and_audit(spark, inputs):
    t = dataset.assemble(inputs, radius=30.0).cache()
    got = t.orderBy("sample_id").collect()
    assert [(r["cell_id"], r["n"], r["ids"], r["target"]) for r in got[:2]] == [(0, 2, "[2,9]", 1), (14, 1, "[7]", 1)]
    assert [r["sample_id"] for r in got] == [f"sample_{i:06d}" for i in range(1, 5)] and all(r["ids"] == "[]" for r in got[2:])
    assert dataset.assemble(inputs, radius=0.0, seed=7, count=5).count() == 7
    assert all(r["violations"] == 0 for r in dataset.audit(t, inputs, 30.0).collect())
    bad = t.withColumn("x", F.col("x") + 15).withColumn("cell_id", F.when(F.col("target") == 0, 29).otherwise(F.col("cell_id")))
    broken = {r["rule"] for r in dataset.audit(bad, inputs, 30.0).where("violations > 0").collect()}
    assert {"centre", "cell number", "valid cell"} <= broken


def test_points_outside_raise(spark, inputs):
    out = spark.createDataFrame([(1, 175.0, 5.0)], "id long, x double, y double")
    with pytest.raises(ContractError):
        dataset.assemble(dataset.Inputs(inputs.grid, inputs.cells, out, inputs.exclusion, inputs.features, "cover"), 30.0)


def test_scores_cover_the_mask(spark, inputs):
    d = dataset.valid_cells(inputs).withColumn("target", (F.col("cell_id") % 3 == 0).cast("int"))
    models = {"lr": ml.fit(d, "logistic", ["z", "a"], "cover"), "rf": ml.fit(d, "forest", ["z", "a"], "cover", trees=5)}
    s = dataset.score_surface(inputs, models)
    checks = raster.score_checks(s, dataset.valid_cells(inputs), "ensemble").first().asDict()
    assert s.count() == 29 and set(checks.values()) == {0}
    assert raster.score_checks(s.where("cell_id > 0"), dataset.valid_cells(inputs), "ensemble").first()["missing"] == 1


def test_scene_classes_and_windows(spark):
    d = spark.createDataFrame([(r, c, 4 if r or c else 9) for r in range(10) for c in range(10)], "row int, col int, scl int")
    assert raster.invalid_share(d, "scl").first()["percent"] == 1.0 and raster.require_clear(d, "scl").count() == 99
    with pytest.raises(ValueError):
        raster.require_clear(d, "scl", 0.5)
    assert sorted(map(tuple, raster.sample_window(d, 0, 9, 10, 10, 4).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).collect())) == [(0, 3, 6, 9)]
