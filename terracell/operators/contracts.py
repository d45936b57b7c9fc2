"""Data contracts: named rules, all counted in one aggregate, raised with their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite

NODATA = -9999.0


class ContractError(ValueError):
    """Rules that rows break, with their numbers."""

    def __init__(self, broken: dict[str, int]):
        self.broken = broken
        super().__init__("broken rules: " + ", ".join(f"{k} ({n})" for k, n in sorted(broken.items())))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): a rule is a column that is true where a row breaks it; null counts as breaking it."""
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r{i}").alias("violations")) for i, k in enumerate(rules)])).alias("x")
    return counted.select(rows).select("x.rule", "x.violations")


def require(df: DataFrame, rules: dict[str, Column]) -> None:
    """Runs one aggregate and raises ContractError if any rule is broken."""
    broken = {r["rule"]: r["violations"] for r in violations(df, rules).collect() if r["violations"]}
    if broken:
        raise ContractError(broken)


def require_columns(df: DataFrame, columns: list[str], exact: bool = False) -> None:
    """All columns present; with ``exact``, these alone and in this order."""
    missing = [c for c in columns if c not in df.columns]
    if missing or exact and df.columns != columns:
        raise ContractError({f"column {c}": 1 for c in missing} or {"column order": 1})


def feature_rules(features: list[str], target: str = "target", bounds: dict[str, tuple[float, float]] | None = None, sine: str = "aspect_sin", cosine: str = "aspect_cos", tolerance: float = 1e-8) -> dict[str, Column]:
    """Finite features, a binary target, physical bounds and a unit circle where there is one."""
    rules = {f"finite {f}": ~finite(F.col(f)) for f in features}
    rules["target"] = ~F.col(target).isin(0, 1)
    rules |= {f"bounds {f}": ~F.col(f).between(*b) for f, b in (bounds or {}).items()}
    if sine in features and cosine in features:
        rules["unit circle"] = F.abs(F.col(sine) ** 2 + F.col(cosine) ** 2 - 1) > tolerance
    return rules


def qa_rules(numeric: list[str], codes: list[str], half_open: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """No null, infinite or no-data number; whole codes; half-open ranges."""
    rules: dict[str, Column] = {}
    for c in numeric:
        v = F.col(c).cast("double")
        rules |= {f"null {c}": v.isNull(), f"infinite {c}": v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf"))), f"no data {c}": v.isNotNull() & (v == NODATA)}
    rules |= {f"whole {c}": F.col(c).cast("double") != F.floor(c).cast("double") for c in codes}
    rules |= {f"range {c}": (F.col(c) < a) | (F.col(c) >= b) for c, (a, b) in (half_open or {}).items()}
    return rules


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """(what, duplicates): rows beyond the first of equal whole rows, and of equal values of each column; nulls are equal."""
    counted = lambda name, cols: df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(name).alias("what"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    out = counted("rows", df.columns)
    for c in columns:
        out = out.unionByName(counted(c, [c]))
    return out


def require_balanced(df: DataFrame, target: str, least: int = 2) -> None:
    """Both classes with at least so many rows."""
    n = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    if min(n.get(0, 0), n.get(1, 0)) < least:
        raise ContractError({"class too small": 1})


def table_differences(left: DataFrame, right: DataFrame, keys: list[str], rtol: float = 1e-12, atol: float = 1e-12) -> DataFrame:
    """(column, differences) between tables with one row a key: numbers within tolerance and equal nulls agree; missing rows count under the keys."""
    values = [c for c in left.columns if c not in keys]
    numeric = {c for c, t in left.dtypes if t in ("double", "float")}
    a = left.select(*keys, *[F.col(c).alias(f"{c}__a") for c in values], F.lit(1).alias("__a"))
    b = right.select(*keys, *[F.col(c).alias(f"{c}__b") for c in values], F.lit(1).alias("__b"))
    met = a.join(b, keys, "full")
    same: Callable[[str], Column] = lambda c: F.col(f"{c}__a").eqNullSafe(F.col(f"{c}__b")) | (F.coalesce(F.abs(F.col(f"{c}__a") - F.col(f"{c}__b")) <= atol + rtol * F.abs(F.col(f"{c}__b")), F.lit(False)) if c in numeric else F.lit(False))
    rules = {"keys": F.col("__a").isNull() | F.col("__b").isNull()} | {c: F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~same(c) for c in values}
    return violations(met, rules).select(F.col("rule").alias("column"), F.col("violations").alias("differences"))
