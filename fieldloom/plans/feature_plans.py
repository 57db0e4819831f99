"""Queries on pixel neighbourhoods and temporal cubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.scalar import argmax, lag_differences, stable
from fieldloom.operators import neighbourhood as nb
from fieldloom.operators.features import BANDS, band_features
from fieldloom.plans.catalogue import query
from fieldloom.sources.views import CUBE, PX, cube, pixels

_DIFF = "list_transform(range(3, 7), lambda t: ndvi[t] - ndvi[t - 2])"
_DATES = f"""WITH {CUBE}, a AS (SELECT *, list_position(ndvi, list_max(ndvi)) - 1 AS at_max, list_position(ndvi, list_min(ndvi)) - 1 AS at_min,
  list_position({_DIFF}, list_max({_DIFF})) AS at_rise, list_position({_DIFF}, list_min({_DIFF})) AS at_fall FROM cube)"""
_KINDS = ("max", "min", "rise", "fall")


@query("band_argmax_features", _DATES + " SELECT id, " + ", ".join(f"CAST(at_{k} AS INT) AS at_{k}" for k in _KINDS) + ", " + ", ".join(f"round({b}[at_{k} + 1] + 1e-9, 6) AS {b}_{k}" for k in _KINDS for b in BANDS) + " FROM a")
def band_argmax_features(spark, sf_dir):
    f = band_features(cube(spark, sf_dir))
    return f.select("id", *[f"at_{k}" for k in _KINDS], *[stable(f"{b}_{k}").alias(f"{b}_{k}") for k in _KINDS for b in BANDS])


@query("lag2_ndvi_extremes", f"WITH {CUBE} SELECT id, round(list_max({_DIFF}) + 1e-9, 6) AS rise, round(list_min({_DIFF}) + 1e-9, 6) AS fall, CAST(list_position({_DIFF}, list_max({_DIFF})) - 1 AS INT) AS at FROM cube".replace(" AS at FROM", ' AS "at" FROM'))
def lag2_ndvi_extremes(spark, sf_dir):
    d = lag_differences(F.col("ndvi"))
    return cube(spark, sf_dir).select("id", stable(F.array_max(d)).alias("rise"), stable(F.array_min(d)).alias("fall"), argmax(d).cast("int").alias("at"))


@query("temporal_mean", f"WITH {CUBE} SELECT id, " + ", ".join(f"round(list_sum({b}) / 6 + 1e-9, 6) AS {b}" for b in BANDS) + " FROM cube")
def temporal_mean(spark, sf_dir):
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + x) / 6
    return cube(spark, sf_dir).select("id", *[stable(mean(b)).alias(b) for b in BANDS])


@query("segment_spectral_means", f"WITH {CUBE} SELECT label, count(*) AS n, " + ", ".join(f"round(avg({b}[1]) + 1e-9, 6) AS {b}" for b in BANDS) + " FROM cube GROUP BY label")
def segment_spectral_means(spark, sf_dir):
    return cube(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), *[stable(F.avg(F.get(b, F.lit(0)))).alias(b) for b in BANDS])


@query("segment_std", f"WITH {PX} SELECT tile, pred, round(stddev_pop(value) + 1e-9, 5) AS std, round(avg(value) + 1e-9, 6) AS mean FROM px WHERE pred IS NOT NULL GROUP BY tile, pred")
def segment_std(spark, sf_dir):
    return pixels(spark, sf_dir).where("pred IS NOT NULL").groupBy("tile", "pred").agg(stable(F.stddev_pop("value"), 5).alias("std"), stable(F.avg("value")).alias("mean"))


@query("segment_entropy", f"""WITH {PX}, b AS (SELECT tile, pred, least(CAST(floor((value / 100 - 1 + 1) / 2 * 100) AS BIGINT), 99) AS bin, count(*) AS n FROM px WHERE pred IS NOT NULL AND value / 100 - 1 BETWEEN -1 AND 1 GROUP BY ALL)
SELECT tile, pred, round(ln(sum(n)) - sum(n * ln(n)) / sum(n) + 1e-9, 6) AS entropy FROM b GROUP BY tile, pred""")
def segment_entropy(spark, sf_dir):
    px = pixels(spark, sf_dir).where("pred IS NOT NULL")
    return nb.entropy(px, ["tile", "pred"], F.col("value") / 100 - 1).select("tile", "pred", stable("entropy").alias("entropy"))


@query("segment_majority", f"WITH {PX} SELECT tile, pred, avg(CASE WHEN gt IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.5 AS is_field FROM px WHERE pred IS NOT NULL GROUP BY tile, pred")
def segment_majority(spark, sf_dir):
    px = pixels(spark, sf_dir).where("pred IS NOT NULL")
    return px.groupBy("tile", "pred").agg((F.avg(F.col("gt").isNotNull().cast("double")) > 0.5).alias("is_field"))


@query("small_object_removal", f"WITH {PX} SELECT tile, r, c, CASE WHEN count(*) OVER (PARTITION BY tile, pred) >= 15 THEN pred END AS pred FROM px")
def small_object_removal(spark, sf_dir):
    return nb.without_small(pixels(spark, sf_dir), "pred", 15).select("tile", "r", "c", "pred")


@query("pad_edge", f"WITH {PX} SELECT tile, r, c, CASE WHEN r IN (0, 15) OR c IN (0, 15) THEN 1 WHEN value > 50 THEN 1 ELSE 0 END AS edge FROM px")
def pad_edge(spark, sf_dir):
    return nb.padded_edge(pixels(spark, sf_dir), F.col("value") > 50, 15, "edge").select("tile", "r", "c", "edge")


def _moving(size):
    k = size // 2
    side = lambda x: f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > 15 THEN 30 - ({x}) ELSE {x} END"
    return f"""WITH {PX}, w AS (SELECT * FROM px), o AS (SELECT a, b FROM range({-k}, {k + 1}) x(a), range({-k}, {k + 1}) y(b)),
n AS (SELECT w.tile, w.r, w.c, {side('w.r + a')} AS rr, {side('w.c + b')} AS cc FROM w, o)
SELECT n.tile, n.r, n.c, round(stddev_pop(v.value) + 1e-9, 4) AS std FROM n JOIN w v ON v.tile = n.tile AND v.r = n.rr AND v.c = n.cc GROUP BY ALL"""


def _moving_std(spark, sf_dir, size):
    return nb.moving_std(pixels(spark, sf_dir), ["value"], size, 15, ["std"]).select("tile", "r", "c", stable("std", 4).alias("std"))


@query("moving_std_3", _moving(3))
def moving_std_3(spark, sf_dir):
    return _moving_std(spark, sf_dir, 3)


@query("moving_std_5", _moving(5))
def moving_std_5(spark, sf_dir):
    return _moving_std(spark, sf_dir, 5)


_PAIRS = f"""WITH {PX}, s AS (SELECT tile, r, c, pred FROM px WHERE pred IS NOT NULL),
pr AS (SELECT DISTINCT x.tile, least(x.pred, y.pred) AS a, greatest(x.pred, y.pred) AS b FROM s x JOIN s y ON x.tile = y.tile AND ((y.r = x.r AND y.c = x.c + 1) OR (y.c = x.c AND y.r = x.r + 1)) WHERE x.pred <> y.pred)"""


@query("adjacency_pairs", _PAIRS + " SELECT tile, a, b FROM pr")
def adjacency_pairs(spark, sf_dir):
    return nb.adjacent_pairs(pixels(spark, sf_dir), "pred")


@query("neighbor_stats", _PAIRS + """, m AS (SELECT tile, pred AS label, avg(value) AS x FROM px WHERE pred IS NOT NULL GROUP BY ALL),
e AS (SELECT tile, a AS label, b AS other FROM pr UNION ALL SELECT tile, b, a FROM pr)
SELECT e.tile, e.label, count(x) AS nb_count, round(avg(x) + 1e-9, 4) AS nb_mean, round(coalesce(sqrt(greatest((sum(x * x) - sum(x) * sum(x) / count(x)) / greatest(count(x) - 1, 1), 0)), 0) + 1e-9, 4) AS nb_std
FROM e JOIN m ON m.tile = e.tile AND m.label = e.other GROUP BY e.tile, e.label""")
def neighbor_stats(spark, sf_dir):
    px = pixels(spark, sf_dir)
    means = px.where("pred IS NOT NULL").groupBy("tile", F.col("pred").alias("label")).agg(F.avg("value").alias("x"))
    out = nb.neighbour_statistics(nb.adjacent_pairs(px, "pred"), means, "x")
    return out.select("tile", "label", "nb_count", stable("nb_mean", 4).alias("nb_mean"), stable("nb_std", 4).alias("nb_std"))
