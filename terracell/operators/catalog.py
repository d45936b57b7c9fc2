"""Nested scene catalogues: flattening, aliases, last-wins rows, scene choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An item as it is stored: loosely typed properties and named assets.
ITEM_SCHEMA = "id string, collection string, properties map<string, string>, assets map<string, struct<href: string, alternate: map<string, struct<href: string>>>>"


def items(pages: DataFrame, column: str = "json") -> DataFrame:
    """One row an item, from pages that are feature collections as JSON text, with the page's number."""
    parsed = F.from_json(column, f"features array<struct<{ITEM_SCHEMA.replace('id string', 'id: string', 1).replace(', collection string', ', collection: string').replace('properties map', 'properties: map').replace('assets map', 'assets: map')}>>")
    return pages.select("page", F.explode(parsed["features"]).alias("i")).select("page", "i.*")


def flatten(df: DataFrame) -> DataFrame:
    """(id, collection, taken, cloud_cover, platform, n_assets): the start stands in for a missing time; an unreadable cover is null."""
    p = F.col("properties")
    taken = F.coalesce(p["datetime"], p["start_datetime"])
    return df.select("id", "collection", F.try_to_timestamp(taken).alias("taken"), p["eo:cloud_cover"].try_cast("double").alias("cloud_cover"), F.coalesce(p["platform"], p["constellation"], F.lit("N/A")).alias("platform"), F.coalesce(F.size("assets"), F.lit(0)).alias("n_assets"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in ``order``, which must differ among them; null comes first. Combined before the shuffle."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(order)).alias("__row"))
    return last.select("__row.*")


def by_time(df: DataFrame, time: str, key: str) -> DataFrame:
    """Ascending, unknown times last."""
    return df.orderBy(F.asc_nulls_last(time), key)


def select_scenes(df: DataFrame, dates: list[str], tile: str) -> DataFrame:
    """Items of a tile taken on one of the dates. Exactly one a date, else it raises; counts them."""
    got = df.where(F.col("id").contains(f"_{tile}_")).withColumn("date", F.to_date("taken")).where(F.col("date").cast("string").isin(dates))
    n = {str(r["date"]): r["count"] for r in got.groupBy("date").count().collect()}
    wrong = [d for d in dates if n.get(d, 0) != 1]
    if wrong:
        raise ValueError(f"not exactly one scene on {', '.join(wrong)}")
    return got


def cover_counts(df: DataFrame, cover: str, thresholds: tuple[float, ...] = (10, 20, 30)) -> DataFrame:
    """One row: items, unknown covers, extremes, mean, and items at or below each threshold."""
    c = F.col(cover)
    return df.agg(F.count(F.lit(1)).alias("items"), F.count_if(c.isNull()).alias("unknown"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), *[F.count_if(c <= t).alias(f"upto_{t:g}") for t in thresholds])


def asset_paths(df: DataFrame) -> DataFrame:
    """(id, asset, scheme, host, path) of every asset's address and its alternates; addresses with a query or a fragment are left out."""
    every = df.select("id", F.explode("assets").alias("asset", "a")).select("id", "asset", F.explode(F.concat(F.array("a.href"), F.coalesce(F.transform(F.map_values("a.alternate"), lambda x: x["href"]), F.array().cast("array<string>")))).alias("href"))
    part = lambda p: F.parse_url("href", F.lit(p))
    return every.where(F.col("href").isNotNull() & part("QUERY").isNull() & part("REF").isNull()).select("id", "asset", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"))
