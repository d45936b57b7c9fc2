"""Tables that the queries run on, derived by whole-number arithmetic from the driver's, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import round_as_sql
from ..grid import GridSpec

WIDTH, CELL = 50, 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense grid of 50 columns: one cell a part."""
    p = table(spark, sf_dir, "part")
    row, col = F.expr("CAST(p_partkey DIV 50 AS INT)"), F.expr("CAST(p_partkey % 50 AS INT)")
    d = p.select(F.col("p_partkey").alias("cell_id"), row.alias("row"), col.alias("col"), (F.col("p_retailprice") + F.col("p_size")).alias("z"), F.expr("CAST(p_size % 7 AS INT)").alias("land_cover"))
    return d.withColumns({"x": F.col("col") * CELL + 15, "y": F.col("row") * CELL + 15})


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid; a count from file metadata."""
    return -(-table(spark, sf_dir, "part").count() // WIDTH)


def grid(spark: SparkSession, sf_dir: str) -> GridSpec:
    return GridSpec(0.0, 0.0, CELL, CELL, WIDTH, height(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("event_id", F.expr("CAST((event_id * 7919) % 15000 AS DOUBLE) / 10").alias("x"), F.expr("CAST((event_id * 10473) % 12000 AS DOUBLE) / 10").alias("y"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), round_as_sql(F.least(F.lit(1.0), F.col("n_chars") / F.lit(20000.0)), 3).alias("p"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.to_date("ts").alias("scene"), F.col("value").alias("v"))


CELLS = """cells AS (SELECT p_partkey AS cell_id, CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col,
  p_retailprice + p_size AS z, CAST(p_size % 7 AS INTEGER) AS land_cover,
  CAST((p_partkey % 50) * 30 + 15 AS DOUBLE) AS x, CAST((p_partkey // 50) * 30 + 15 AS DOUBLE) AS y FROM part)"""
POINTS = """pts AS (SELECT event_id, CAST((event_id * 7919) % 15000 AS DOUBLE) / 10 AS x, CAST((event_id * 10473) % 12000 AS DOUBLE) / 10 AS y
  FROM events WHERE event_type = 'error')"""
SCORED = """scored AS (SELECT doc_id, quality AS y, round(least(CAST(1 AS DOUBLE), n_chars / CAST(20000 AS DOUBLE)), 3) AS p FROM labels JOIN documents USING (doc_id))"""
STACK = "stack AS (SELECT user_id AS cell, CAST(ts AS DATE) AS scene, value AS v FROM events)"

OUTER = [(150.0, 90.0), (1200.0, 60.0), (1350.0, 900.0), (600.0, 1080.0), (90.0, 750.0), (150.0, 90.0)]
HOLE = [(450.0, 300.0), (750.0, 300.0), (750.0, 600.0), (450.0, 600.0), (450.0, 300.0)]
