"""Digests of files, frozen manifests and JSON sidecars."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256, md5) of files, read by Spark where they are."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): files that are new, gone or different."""
    a, b = before.select("path", F.col("sha256").alias("a")), after.select("path", F.col("sha256").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("different")
    return a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))


def require_unchanged(before: DataFrame, after: DataFrame) -> None:
    rows = changed(before, after).limit(5).collect()
    if rows:
        raise RuntimeError("files changed: " + ", ".join(f"{r['path']} ({r['change']})" for r in rows))


def strict_json(value) -> str:
    """JSON text; NaN and infinities raise."""
    return json.dumps(value, allow_nan=False, sort_keys=True, indent=2)
