"""Two classifiers on scaled numbers and one-hot codes: L2 logistic regression and a random forest."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest
from .metrics import curve_metrics
from .order import numbered, union_all


class Scaler:
    """(x - mean) / population deviation, learnt from one aggregate; a constant column is only centred."""

    def __init__(self, df: DataFrame, columns: list[str]):
        got = df.agg(*[f(c).alias(f"{c}__{i}") for c in columns for i, f in enumerate((F.avg, F.stddev_pop))]).first()
        self.of = {c: (got[f"{c}__0"], got[f"{c}__1"] or 1.0) for c in columns}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}__z": (F.col(c) - m) / s for c, (m, s) in self.of.items()})


class Classifier:
    """Scaler, encoder and model together. Unknown categories have all indicators 0."""

    def __init__(self, scaler: Scaler, model: PipelineModel | forest.Forest, code: str, known: list[str]):
        self.scaler, self.model, self.code, self.known = scaler, model, code, known

    def scores(self, df: DataFrame, out: str = "p") -> DataFrame:
        """df with the probability of class 1."""
        kept = df.columns
        d = self.scaler.transform(df).withColumn("__code", F.col(self.code).cast("string"))
        if isinstance(self.model, forest.Forest):
            return d.withColumn(out, self.model.probability([f"{c}__z" for c in self.scaler.of], "__code")).select(*kept, out)
        d = self.model.transform(d)
        return d.withColumn(out, vector_to_array("probability")[1]).select(*kept, out)

    def unknown(self, df: DataFrame) -> DataFrame:
        """(code, n): categories that training did not have, and their rows."""
        return df.where(~F.col(self.code).cast("string").isin(self.known)).groupBy(F.col(self.code).alias("code")).agg(F.count(F.lit(1)).alias("n"))

    def importances(self) -> list[tuple[str, float]]:
        """Coefficients or impurity importances by feature, largest magnitude first, then by name."""
        v = self.model.importance if isinstance(self.model, forest.Forest) else self.model.stages[-1].coefficients.toArray()
        names = [f"{c}" for c in self.scaler.of] + [f"{self.code}={k}" for k in self.known]
        return sorted(zip(names, v.tolist()), key=lambda x: (-abs(x[1]), x[0]))


def fit(df: DataFrame, kind: str, numbers: list[str], code: str, target: str = "target", seed: int = 42, trees: int = 500, iterations: int = 5000) -> Classifier:
    """Fits "logistic" (C = 1) or "forest" on all rows of df; acts on the data."""
    scaler = Scaler(df, numbers)
    d = scaler.transform(df).withColumn("__code", F.col(code).cast("string")).withColumn("__y", F.col(target).cast("double")).cache()
    try:
        n = d.count()
        if kind == "forest":
            grown = forest.fit(d, [f"{c}__z" for c in numbers], "__code", "__y", trees, depth=8, least=5, seed=seed)
            return Classifier(scaler, grown, code, grown.known)
        if kind != "logistic":
            raise ValueError(f"no such model: {kind}")
        stages = [StringIndexer(inputCol="__code", outputCol="__index", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol="__index", outputCol="__hot", dropLast=True), VectorAssembler(inputCols=[f"{c}__z" for c in numbers] + ["__hot"], outputCol="__features")]
        # C = 1 weighs the sum of losses; regParam weighs their mean.
        stages.append(LogisticRegression(featuresCol="__features", labelCol="__y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-10))
        model = Pipeline(stages=stages).fit(d)
    finally:
        d.unpersist()
    if model.stages[-1].summary.totalIterations >= iterations:
        raise RuntimeError("logistic regression did not converge")
    return Classifier(scaler, model, code, list(model.stages[0].labels))


def cross_validate(df: DataFrame, folds: list[int], kind: str, numbers: list[str], code: str, target: str = "target", train=None, **options) -> DataFrame:
    """Out-of-fold probabilities. train(fold) gives the training rows (default: the other folds); all folds are checked before the first fit."""
    parts = {k: (train(k) if train else df.where(F.col("fold") != k)) for k in folds}
    for k, rows in parts.items():
        if rows.agg(F.count_distinct(target)).first()[0] < 2:
            raise ValueError(f"fold {k}: training rows of one class only")
    out = None
    for k in folds:
        got = fit(parts[k], kind, numbers, code, target, **options).scores(df.where(F.col("fold") == k))
        out = got if out is None else out.unionByName(got)
    return out


def holdout(df: DataFrame, kind: str, numbers: list[str], code: str, target: str = "target", split: str = "split", **options) -> tuple[Classifier, DataFrame]:
    """A classifier of the rows whose split is "train", and its metrics on them and on those whose split is "test", a row each."""
    fitted = fit(df.where(F.col(split) == "train"), kind, numbers, code, target, **options)
    rows = [curve_metrics(fitted.scores(df.where(F.col(split) == part)), y=target).withColumn(split, F.lit(part)) for part in ("train", "test")]
    return fitted, union_all(rows)


def _digest(folder: Path) -> str:
    """SHA-256 of a folder's files, by their names and contents in order of their names; checksum and marker files are left out."""
    total = hashlib.sha256()
    for p in sorted(folder.rglob("*")):
        if p.is_file() and not p.name.startswith((".", "_")):
            total.update(f"{p.relative_to(folder)}\n{hashlib.sha256(p.read_bytes()).hexdigest()}\n".encode())
    return total.hexdigest()


def save(model: Classifier, folder: str | Path) -> str:
    """Writes a classifier to a new folder on a mounted file system; returns the SHA-256 that ``load`` asks for."""
    folder = Path(folder)
    folder.mkdir(parents=True)
    if isinstance(model.model, forest.Forest):
        model.model.save(folder / "forest.npz")
    else:
        model.model.save((folder / "model").as_uri())
    # Numbers stay in the order in which the model asks them.
    (folder / "classifier.json").write_text(json.dumps({"scaler": model.scaler.of, "code": model.code, "known": model.known}))
    return _digest(folder)


def load(folder: str | Path, sha256: str) -> Classifier:
    """A classifier as it was saved; raises, before anything of it is read as a model, if its digest is another."""
    folder = Path(folder)
    if _digest(folder) != sha256:
        raise ValueError(f"{folder} is not the model with this digest")
    held = json.loads((folder / "classifier.json").read_text())
    scaler = Scaler.__new__(Scaler)
    scaler.of = {c: tuple(v) for c, v in held["scaler"].items()}
    model = forest.Forest.load(folder / "forest.npz") if (folder / "forest.npz").exists() else PipelineModel.load((folder / "model").as_uri())
    return Classifier(scaler, model, held["code"], held["known"])


def ensemble(df: DataFrame, a: str, b: str, out: str = "ensemble") -> DataFrame:
    """Mean of two scores in double precision."""
    return df.withColumn(out, (F.col(a).cast("double") + F.col(b).cast("double")) / 2)


def row_number_of(df: DataFrame, order: str, out: str = "source_row") -> DataFrame:
    """0, 1, ... by an order column, which must be total; numbered range by range."""
    return numbered(df, order, out).withColumn(out, F.col(out) - 1)
