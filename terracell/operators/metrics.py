"""Classification metrics that are exact with ties, and comparisons of metrics and score surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe_div
from .order import numbered, running

METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]


def confusion(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Counts and rates at ``p >= threshold``; a rate over nothing is 0."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    d = df.groupBy(*(by or [])).agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    rate = lambda a, b: F.coalesce(safe_div(a.cast("double"), b.cast("double")), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return d.withColumns({"accuracy": rate(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (rate(tp, tp + fn) + rate(tn, tn + fp)) / 2, "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def _curve(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """A row for each distinct score, from the highest: its rows and hits, and all rows (n) and hits (tp) so far."""
    tied = df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col(y) == 1).alias("k"))
    return running(tied, p, {"n": F.col("m"), "tp": F.col("k")}, by, descending=True)


def curve_metrics(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """roc_auc, pr_auc (trapezoids, from precision 1 at recall 0) and average_precision; null where a class is missing.

    Each distinct score adds its own trapezoids; the point before it follows from its own counts, so no
    row looks at another.
    """
    by = by or []
    c = _curve(df, y, p, by)
    fp, before_n, before_tp = F.col("n") - F.col("tp"), F.col("n") - F.col("m"), F.col("tp") - F.col("k")
    before_fp = before_n - before_tp
    precision = F.col("tp") / F.col("n")
    before = F.when(before_n == 0, 1.0).otherwise(F.try_divide(before_tp.cast("double"), before_n.cast("double")))
    d = c.groupBy(*by).agg(
        F.sum("k").alias("__p"), F.sum(F.col("m") - F.col("k")).alias("__n"),
        F.sum((fp - before_fp) * (F.col("tp") + before_tp) / 2).alias("__roc"),
        F.sum(F.col("k") * (precision + before) / 2).alias("__pr"),
        F.sum(F.col("k") * precision).alias("__ap"),
    )
    both = lambda v: F.when(F.col("__n") > 0, v)
    return d.select(*by, safe_div(F.col("__roc"), (F.col("__p") * F.col("__n")).cast("double")).alias("roc_auc"), both(safe_div(F.col("__pr"), F.col("__p").cast("double"))).alias("pr_auc"), both(safe_div(F.col("__ap"), F.col("__p").cast("double"))).alias("average_precision"))


def roc_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(score, fp, tp): a curve's corners."""
    return _curve(df, y, p, []).select(F.col(p).alias("score"), (F.col("n") - F.col("tp")).alias("fp"), "tp")


def ecdf(df: DataFrame, value: str, then: list[str]) -> DataFrame:
    """df with ``ecdf`` = place / n by ascending value, equal values in order of ``then``."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return numbered(df, value, "__i", then).crossJoin(F.broadcast(n)).withColumn("ecdf", F.col("__i") / F.col("__n")).drop("__i", "__n")


def fold_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Unweighted mean, sample deviation and extremes over folds of each metric."""
    d = df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(by, metrics, "metric", "value")
    return d.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Full outer join by keys, with the side that a row is on and right less left of each metric."""
    a = left.select(*keys, *[F.col(m).alias(f"{m}_left") for m in metrics], F.lit(1).alias("__a"))
    b = right.select(*keys, *[F.col(m).alias(f"{m}_right") for m in metrics], F.lit(1).alias("__b"))
    side = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").otherwise("both")
    return a.join(b, keys, "full").withColumn("side", side).withColumns({f"{m}_delta": F.col(f"{m}_right") - F.col(f"{m}_left") for m in metrics}).drop("__a", "__b")


def score_distribution(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    v = F.col(score)
    d = df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, [0.05, 0.25, 0.5, 0.75, 0.95]).alias("__q"), F.count_if((v < 0) | (v > 1)).alias("outside"))
    return d.withColumns({k: F.col("__q")[i] for i, k in enumerate(("p05", "p25", "median", "p75", "p95"))}).drop("__q")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson correlation (null if constant), mean absolute and root mean squared difference, mean, least and greatest of a - b."""
    x, y = F.col(a), F.col(b)
    d = x - y
    return df.agg(F.count(d).alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("pearson"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("mean_signed"), F.min(d).alias("min_signed"), F.max(d).alias("max_signed"))


def probability_faults(y: str = "y", p: str = "p") -> Column:
    """Counts that must be 0 before metrics are taken."""
    return F.struct(F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1)).alias("bad_class"), F.count_if(F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)).alias("bad_probability"), F.when(F.count_distinct(y) < 2, 1).otherwise(0).alias("one_class"))
