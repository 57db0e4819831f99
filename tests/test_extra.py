import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.scalar import hyperbolised, laea_to_degrees
from fieldloom.operators import matching as mt
from tests.test_operators import raster


def test_projection_of_known_points(spark):
    # the origin, and the published example: 50 N 5 E is E 3962799.45, N 2999718.85
    df = spark.createDataFrame([(4321000.0, 3210000.0), (3962799.45, 2999718.85)], "x double, y double")
    lon, lat = laea_to_degrees(F.col("x"), F.col("y"))
    a, b = df.select(lon.alias("lon"), lat.alias("lat")).collect()
    assert (a.lon, a.lat) == (pytest.approx(10, abs=1e-7), pytest.approx(52, abs=1e-7))
    assert (b.lon, b.lat) == (pytest.approx(5, abs=1e-6), pytest.approx(50, abs=1e-6))


def test_hyperbolisation(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    got = [r.y for r in df.select(hyperbolised(F.col("x"), F.lit(0.0), F.lit(10.0)).alias("y")).collect()]
    assert got[0] == 0 and got[2] == pytest.approx(1) and got[1] == pytest.approx((math.exp(-(0.5**0.8)) - 1) / (math.exp(-1) - 1))


def test_boundary_iou(spark):
    labels = [[1] * 8 for _ in range(8)]
    px = raster(spark, labels)
    pairs = mt.object_overlaps(px).select("tile", "gt", "pred")
    assert mt.inner_rings(px, "gt", 2, 7).where("gt_ring").count() == 64 - 16
    assert mt.boundary_iou(px, pairs, 2, 7).first().iou_boundary == 1
    half = raster(spark, labels, [[1] * 4 + [0] * 4 for _ in range(8)])
    r = mt.boundary_iou(half, mt.object_overlaps(half).select("tile", "gt", "pred"), 2, 7).first()
    assert r.iou_boundary == pytest.approx(24 / (48 + 32 - 24))
