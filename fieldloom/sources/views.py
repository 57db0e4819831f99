"""Raster, field and instance views over star-schema tables, and the tables themselves.

Every view is a projection or one aggregation, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 tiles: tile, r, c, value, gt and pred labels (null: none)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 256 AS tile", "(event_id div 16) % 16 AS r", "event_id % 16 AS c", "value",
        "CASE WHEN value >= 5 THEN ((event_id div 16) % 16 div 4) * 4 + (event_id % 16 div 4) + 1 END AS gt",
        "CASE WHEN value <= 200 THEN (((event_id div 16) % 16 + 1) div 5) * 4 + ((event_id % 16 + 2) div 5) + 1 END AS pred",
    )


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bands of six dates for each vector: id, label, blue, green, red, nir, ndvi."""
    e = table(spark, sf_dir, "embeddings")
    bands = [F.transform(F.slice("embedding", 1 + 6 * k, 6), lambda x: x.cast("double")).alias(b) for k, b in enumerate(("blue", "green", "red", "nir", "ndvi"))]
    return e.select(F.col("vec_id").alias("id"), "label", *bands)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of tiles: tile_id, field_id, area, n_lines, cls_0 .. cls_4, agri."""
    o, l, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    classes = [F.count_if(F.col("p_size") % 5 == k).alias(f"cls_{k}") for k in range(5)]
    return joined.groupBy((F.col("o_custkey") % 50).alias("tile_id"), F.col("o_orderkey").alias("field_id")).agg(
        F.sum("l_quantity").cast("double").alias("area"), F.count("*").alias("n_lines"), *classes,
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("double").alias("agri"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored boxes: inst, tile, x0, y0, w, h, score."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS inst", "event_id div 64 AS tile", "(event_id * 7) % 97 AS x0", "(event_id * 13) % 89 AS y0",
        "5 + event_id % 13 AS w", "5 + event_id % 11 AS h", "value AS score",
    )


#: The same views as CTEs for the oracle.
PX = """px AS (SELECT event_id // 256 AS tile, (event_id // 16) % 16 AS r, event_id % 16 AS c, value,
  CASE WHEN value >= 5 THEN ((event_id // 16) % 16 // 4) * 4 + (event_id % 16 // 4) + 1 END AS gt,
  CASE WHEN value <= 200 THEN (((event_id // 16) % 16 + 1) // 5) * 4 + ((event_id % 16 + 2) // 5) + 1 END AS pred FROM events)"""
CUBE = """cube AS (SELECT vec_id AS id, label, CAST(embedding[1:6] AS DOUBLE[]) AS blue, CAST(embedding[7:12] AS DOUBLE[]) AS green,
  CAST(embedding[13:18] AS DOUBLE[]) AS red, CAST(embedding[19:24] AS DOUBLE[]) AS nir, CAST(embedding[25:30] AS DOUBLE[]) AS ndvi FROM embeddings)"""
FIELDS = """fields AS (SELECT o_custkey % 50 AS tile_id, o_orderkey AS field_id, CAST(sum(l_quantity) AS DOUBLE) AS area, count(*) AS n_lines,
  count(*) FILTER (p_size % 5 = 0) AS cls_0, count(*) FILTER (p_size % 5 = 1) AS cls_1, count(*) FILTER (p_size % 5 = 2) AS cls_2,
  count(*) FILTER (p_size % 5 = 3) AS cls_3, count(*) FILTER (p_size % 5 = 4) AS cls_4,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) AS agri
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
INST = """inst AS (SELECT event_id AS inst, event_id // 64 AS tile, (event_id * 7) % 97 AS x0, (event_id * 13) % 89 AS y0,
  5 + event_id % 13 AS w, 5 + event_id % 11 AS h, value AS score FROM events)"""
