"""The forest against splits by hand, a tree grown row by row, and its own promises."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import forest, metrics, ml


def noisy(spark, n, seed=7):
    """Two numbers, a code and a class that follows them, with noise."""
    rng = np.random.default_rng(seed)
    z, x, code = rng.normal(size=n), rng.integers(0, 5, n), rng.integers(0, 3, n)
    y = (z + (x > 2) - (code == 1) + rng.normal(size=n) * 0.5 > 0.3).astype(int)
    return spark.createDataFrame([(i, *map(float, (a, b)), int(c), int(t)) for i, (a, b, c, t) in enumerate(zip(z, x, code, y))], "id long, z double, x double, code int, target int")


def test_large_tables_of_repeated_rows_are_learnt_in_time(spark):
    """900,000 rows, 200 trees: row by row and tree by tree this takes more than 100 s."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40))
    d = spark.range(900_000).select("id", h(1).cast("double").alias("z"), h(2).cast("double").alias("x"), (F.col("id") % 3).alias("code"), ((h(1) + h(2) + h(3) / 4) > 44).cast("int").alias("target"))
    began = time.time()
    got = metrics.curve_metrics(ml.fit(d, "forest", ["z", "x"], "code", trees=200).scores(d), y="target").first()
    assert time.time() - began < 100 and got["roc_auc"] > 0.97


def test_best_split_against_every_split():
    rng = np.random.default_rng(2)
    rows = [(rng.integers(0, 6, 90), rng.integers(0, 9, 90), rng.integers(0, 2, 90)) for _ in range(3)]
    h = np.zeros((2, 3, forest.BINS, 2))
    for node, (u, v, y) in enumerate(rows):
        np.add.at(h[0, node], (u, y), 1)
        np.add.at(h[1, node], (v, y), 1)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    feature, cut, gain, left, right = forest._best(h, np.array([[4, 9]] * 3), 5)
    for node in range(3):
        total, best = h[0, node].sum(0), (0.0,)
        for slot in range(2):
            for c in range(forest.BINS - 1):
                a, b = h[slot, node, : c + 1].sum(0), h[slot, node, c + 1 :].sum(0)
                if min(a.sum(), b.sum()) >= 5:
                    g = gini(total) - (a.sum() * gini(a) + b.sum() * gini(b)) / total.sum()
                    best = max(best, (g, (4, 9)[slot], c, a.tolist(), b.tolist()), key=lambda v: round(v[0], 12))
        assert gain[node] == pytest.approx(best[0]) and (feature[node], cut[node], left[node].tolist(), right[node].tolist()) == best[1:]


def test_shares_are_those_of_the_rows_in_each_leaf(spark, monkeypatch):
    """With every row drawn as often as it occurs and all features asked, a tree is the plain greedy one."""
    d = noisy(spark, 400).withColumns({"__y": F.col("target").cast("double"), "__code": F.col("code").cast("string")})
    monkeypatch.setattr(forest, "_drawn", lambda rng, runs, tables: np.concatenate([np.full(n, c) for c, n in runs]))
    monkeypatch.setattr(forest.math, "sqrt", lambda v: v)
    try:
        got = forest.fit(d, ["z", "x"], "__code", "__y", trees=2, depth=3)
    finally:
        monkeypatch.undo()
    table = d.select("z", "x", "code", "target").collect()
    bins = np.array([[np.searchsorted(got.cuts[0], r["z"]), np.searchsorted(got.cuts[1], r["x"]), *[int(r["code"] == k) for k in range(3)]] for r in table])
    y = np.array([r["target"] for r in table])
    assert [len(c) for c in got.cuts] == [31, 4]

    def grow(rows, depth):
        p, best = y[rows].mean(), (1e-12,)
        if depth and len(rows) >= 10:
            for f in range(5):
                for c in range(bins[:, f].max()):
                    a, b = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                    if min(len(a), len(b)) >= 5:
                        g = p * (1 - p) - sum(len(s) * y[s].mean() * (1 - y[s].mean()) for s in (a, b)) / len(rows)
                        best = max(best, (g, a, b), key=lambda v: round(v[0], 12))
        if len(best) == 1:
            return {int(i): p for i in rows}
        return grow(best[1], depth - 1) | grow(best[2], depth - 1)

    want = grow(np.arange(len(y)), 3)
    have = [r["p"] for r in d.withColumn("p", got.probability(["z", "x"], "__code")).collect()]
    assert have == pytest.approx([want[i] for i in range(len(y))])
    assert got.importance.sum() == pytest.approx(1) and got.importance.argmax() == 0


def test_bootstrap_numbers_are_poisson():
    tables = {c: forest._poisson(c) for c in range(1, 65)}
    got = forest._drawn(np.random.Generator(np.random.PCG64(1)), [(1, 200_000), (9, 200_000), (80, 200_000)], tables).reshape(3, -1)
    assert got.mean(1) == pytest.approx([1, 9, 80], rel=0.01) and got.var(1) == pytest.approx([1, 9, 80], rel=0.02)
    assert (got[0] == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


def test_forest_repeats_and_saves_and_meets_bad_rows(spark, tmp_path, monkeypatch):
    d = noisy(spark, 2000)
    fitted = ml.fit(d, "forest", ["z", "x"], "code", trees=30)
    p = lambda m, of=d: [r["p"] for r in m.scores(of).orderBy("id").collect()]
    again = ml.load(tmp_path / "m", ml.save(fitted, tmp_path / "m"))
    assert p(fitted) == p(ml.fit(d, "forest", ["z", "x"], "code", trees=30)) == p(again)
    assert again.importances() == fitted.importances()
    monkeypatch.setattr(forest, "HELD", 1 << 16)
    assert p(fitted) == p(ml.fit(d, "forest", ["z", "x"], "code", trees=30))  # trees counted in several passes
    assert fitted.importances()[0][0] == "z" and metrics.curve_metrics(fitted.scores(d), y="target").first()["roc_auc"] > 0.9
    new = spark.createDataFrame([(0, 0.0, 1.0, 99, 0), (1, 0.0, 1.0, None, 0)], d.schema)
    assert p(fitted, new)[0] == p(fitted, new)[1] and 0 < p(fitted, new)[0] < 1  # unknown and null codes have no indicator
    with pytest.raises(Exception, match="a number is null"):
        p(fitted, d.limit(1).withColumn("z", F.lit(None).cast("double")))
    with pytest.raises(ValueError):
        ml.fit(d.limit(0), "forest", ["z"], "code")
