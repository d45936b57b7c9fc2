"""Descriptive, circular, rank and comparison statistics of long tables (class, variable, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import circular_degrees, safe_div
from .order import average_rank

QUANTILES = {"p05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95}


def distribution(df: DataFrame, *by: str) -> DataFrame:
    """Rows and percent of all rows by class."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))  # over one row a class


def long(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """(keys, variable, value)."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(keys, variables, "variable", "value")


def describe(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Count, mean, sample standard deviation, extremes and exact quantiles (linear between neighbours)."""
    v = F.col(value)
    d = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, list(QUANTILES.values())).alias("__q"))
    return d.withColumns({k: F.col("__q")[i] for i, k in enumerate(QUANTILES)}).drop("__q")


def circular(df: DataFrame, by: list[str], degrees: str) -> DataFrame:
    """Mean direction (null if the resultant is at most 1e-12), resultant length in [0, 1], variance and count."""
    r = F.radians(degrees)
    d = df.groupBy(*by).agg(F.count(degrees).alias("n"), F.avg(F.sin(r)).alias("__s"), F.avg(F.cos(r)).alias("__c"))
    length = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.hypot("__s", "__c")))
    d = d.withColumn("resultant", length)
    return d.withColumns({"direction": F.when(F.col("resultant") > 1e-12, circular_degrees(F.col("__s"), F.col("__c"))), "variance": 1 - F.col("resultant")}).drop("__s", "__c")


def tukey(df: DataFrame, by: list[str], value: str, k: float = 1.5) -> DataFrame:
    """df with low and high fences of its class and ``outlier``, strictly beyond them."""
    q = df.groupBy(*by).agg(F.percentile(value, [0.25, 0.75]).alias("__q"))
    iqr = F.col("__q")[1] - F.col("__q")[0]
    fences = q.select(*by, (F.col("__q")[0] - k * iqr).alias("low"), (F.col("__q")[1] + k * iqr).alias("high"))
    joined = df.join(F.broadcast(fences), by)  # one row a class
    return joined.withColumn("outlier", (F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def outlier_summary(flagged: DataFrame, by: list[str]) -> DataFrame:
    return flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("outlier").alias("outliers"), (F.avg(F.col("outlier").cast("double")) * 100).alias("percent"), F.min("low").alias("low"), F.min("high").alias("high"))


def two_sample(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """One row: first less second, in means and medians; standardised by the pooled deviation (null if 0); rank-biserial correlation."""
    two = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    ranked = average_rank(two, "v", "r")
    of = lambda f, g: f(F.when(F.col("g") == g, F.col("v")))
    n = lambda g: F.count_if(F.col("g") == g)
    d = ranked.agg(n(first).alias("n1"), n(second).alias("n2"), of(F.avg, first).alias("m1"), of(F.avg, second).alias("m2"), of(F.median, first).alias("d1"), of(F.median, second).alias("d2"), of(F.var_samp, first).alias("v1"), of(F.var_samp, second).alias("v2"), F.sum(F.when(F.col("g") == first, F.col("r"))).alias("r1"))
    pooled = F.sqrt(safe_div((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return d.select("n1", "n2", (F.col("m1") - F.col("m2")).alias("mean_difference"), (F.col("d1") - F.col("d2")).alias("median_difference"), safe_div(F.col("m1") - F.col("m2"), pooled).alias("standardised_difference"), (safe_div(2 * u, F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"))


def _correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, variables: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, a, b, r) for all pairs a <= b, from one aggregate."""
    by = by or []
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i:]]
    wide = df.groupBy(*by).agg(*[_correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")
    return wide.select(*by, rows).select(*by, "x.a", "x.b", "x.r")


def rank_correlations(df: DataFrame, key: str, variables: list[str], by: list[str] | None = None) -> DataFrame:
    """Spearman: ``correlations`` of average ranks; rows are told apart by ``key``."""
    by = by or []
    ranked = average_rank(long(df, [key, *by], variables), "value", "rank", [*by, "variable"])
    wide = ranked.groupBy(key, *by).pivot("variable", variables).agg(F.first("rank"))
    return correlations(wide, variables, by)


def crosstab(df: DataFrame, group: str, code: str) -> DataFrame:
    """Counts of every group and code that occur, zeros included, and percent within the group."""
    n = df.groupBy(group, code).agg(F.count(F.lit(1)).alias("n"))
    dims = df.select(group).distinct().crossJoin(df.select(code).distinct())  # distinct values only
    full = dims.join(n, [group, code], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.withColumn("percent", safe_div(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(group))))
