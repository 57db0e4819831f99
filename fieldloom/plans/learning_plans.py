"""Queries on feature sets, segmentation, subsets and forests, over pixels that carry a temporal cube."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldloom.functions.scalar import stable
from fieldloom.operators import evaluation as ev
from fieldloom.operators import features as ft
from fieldloom.operators import gradients, models, search, segmentation
from fieldloom.operators import subsetting as sub
from fieldloom.operators.curation import scaled
from fieldloom.operators.kernels import grid, per_tile
from fieldloom.plans.catalogue import query
from fieldloom.plans.shape_plans import _E
from fieldloom.sources.views import CUBE, PX, cube, fields, pixels


def cube_pixels(spark, sf_dir):
    """Pixels with the bands of one of a hundred vectors: tile, r, c, gt, label, is_field, bands."""
    bands = cube(spark, sf_dir).where("id < 100").drop("label")
    px = pixels(spark, sf_dir).withColumn("id", (F.col("tile") * 256 + F.col("r") * 16 + F.col("c")) % 100)
    return px.join(F.broadcast(bands), "id").select("tile", "r", "c", "gt", F.col("pred").alias("label"), F.col("gt").isNotNull().cast("int").alias("is_field"), *ft.BANDS)  # a hundred rows


_DIFF = "list_transform(range(3, 7), lambda t: ndvi[t] - ndvi[t - 2])"
_AT = {
    "max_red": "list_position(red, list_max(red))", "min_ndvi": "list_position(ndvi, list_min(ndvi))", "max_ndvi": "list_position(ndvi, list_max(ndvi))",
    "max_ndvi_incr": f"list_position({_DIFF}, list_max({_DIFF})) + 1", "max_ndvi_decr": f"list_position({_DIFF}, list_min({_DIFF})) + 1",
}
_DATED = f"""WITH {PX}, {CUBE}, cp AS (SELECT tile, r, c, gt, pred AS label, red, green, nir, ndvi FROM px JOIN cube ON cube.id = (tile * 256 + r * 16 + c) % 100),
at_ AS (SELECT *, {", ".join(f"{v} AS at_{k}" for k, v in _AT.items())} FROM cp), dt AS (SELECT tile, r, c, gt, label, {", ".join(f"{b}[at_{d}] AS {b}_{d}" for b in ft.FEATURE_BANDS for d in ft.DATES)} FROM at_)"""
_OWN = [*ft.INDEX, "area", "hu_1", "hu_2", *[f"entropy_{d}" for d in ft.DATES]]
_OBJECTS = _DATED + f""", l AS (SELECT *, CAST(r AS DOUBLE) AS y, CAST(c AS DOUBLE) AS x FROM dt WHERE label IS NOT NULL), ce AS (SELECT tile, label, count(*) AS n, avg(y) AS my, avg(x) AS mx FROM l GROUP BY ALL),
mu AS (SELECT tile, label, n, {", ".join(f"sum(pow(y - my, {p}) * pow(x - mx, {q})) AS mu_{p}{q}" for p in range(4) for q in range(4) if 2 <= p + q <= 3)} FROM l JOIN ce USING (tile, label) GROUP BY ALL),
e AS (SELECT tile, label, {", ".join(f"{v} AS e{k}" for k, v in _E.items())} FROM mu), ab AS (SELECT *, e30 + e12 AS a, e21 + e03 AS b, e30 - 3 * e12 AS u, 3 * e21 - e03 AS v, e20 - e02 AS d FROM e),
hu AS (SELECT tile, label, e20 + e02 AS hu_1, d * d + 4 * e11 * e11 AS hu_2, u * u + v * v AS hu_3, a * a + b * b AS hu_4, u * a * (a * a - 3 * b * b) + v * b * (3 * a * a - b * b) AS hu_5,
  d * (a * a - b * b) + 4 * e11 * a * b AS hu_6, v * a * (a * a - 3 * b * b) - u * b * (3 * a * a - b * b) AS hu_7 FROM ab),
{", ".join(f"b_{d} AS (SELECT tile, label, least(CAST(floor((ndvi_{d} + 1) / 2 * 100) AS BIGINT), 99) AS bin, count(*) AS n FROM l WHERE ndvi_{d} BETWEEN -1 AND 1 GROUP BY ALL), en_{d} AS (SELECT tile, label, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy_{d} FROM b_{d} GROUP BY ALL)" for d in ft.DATES)},
ob AS (SELECT tile, label, avg(CASE WHEN gt IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.5 AS gt_label, count(*) AS area, {", ".join(f"avg({c}) AS {c}" for c in ft.SPECTRAL)}, {", ".join(f"stddev_pop(ndvi_{d}) AS stdv_{d}" for d in ft.DATES)} FROM l GROUP BY ALL),
al AS (SELECT * FROM ob JOIN hu USING (tile, label) {" ".join(f"LEFT JOIN en_{d} USING (tile, label)" for d in ft.DATES)}),
pr AS (SELECT DISTINCT x.tile, x.label AS a, y.label AS b FROM l x JOIN l y ON x.tile = y.tile AND abs(x.r - y.r) + abs(x.c - y.c) = 1 WHERE x.label <> y.label),
nb AS (SELECT pr.tile, pr.a AS label, CAST(count(*) AS DOUBLE) AS neighbours_0, {", ".join(f"coalesce(sum({v}) / count(*), 0) AS neighbours_{n + 1}, coalesce(sqrt(greatest((sum({v} * {v}) - sum({v}) * sum({v}) / count(*)) / greatest(count(*) - 1, 1), 0)), 0) AS neighbours_{n + 1 + len(_OWN)}" for n, v in enumerate(_OWN))}
  FROM pr JOIN al ON al.tile = pr.tile AND al.label = pr.b GROUP BY ALL)"""
_NUMBERS = [*ft.SPECTRAL, *[f"stdv_{d}" for d in ft.DATES], *[f"entropy_{d}" for d in ft.DATES], *[f"hu_{n}" for n in range(1, 8)], *[f"neighbours_{n}" for n in range(27)]]
#: Deviations of nearly equal numbers are compared to fewer places.
_PLACES = {c: 4 if c.startswith(("neighbours", "stdv")) else 6 for c in _NUMBERS}


@query("object_features", _OBJECTS + " SELECT tile || '_' || label AS uid, tile, label AS segment_id, gt_label, area, " + ", ".join(f"round(coalesce({c}, 0) + 1e-9, {p}) + 0.0 AS {c}" if c.startswith("neigh") else f"round({c} + 1e-9, {p}) + 0.0 AS {c}" for c, p in _PLACES.items()) + " FROM al LEFT JOIN nb USING (tile, label)")
def object_features(spark, sf_dir):
    """All 65 features of every segment."""
    found = ft.object_features(cube_pixels(spark, sf_dir))
    return found.select("uid", "tile", "segment_id", "gt_label", "area", *[stable(c, p).alias(c) for c, p in _PLACES.items()])


_SIDE = lambda x: f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > 15 THEN 30 - ({x}) ELSE {x} END"
_WINDOW = lambda k, name: f"""t{name} AS (SELECT n.tile, n.r, n.c, {", ".join(f"stddev_pop(v.{c}) AS text_{name}{i}" for i, c in enumerate(ft.INDEX))} FROM (SELECT tile, r, c, {_SIDE('r + a')} AS rr, {_SIDE('c + b')} AS cc FROM dt, range({-k}, {k + 1}) x(a), range({-k}, {k + 1}) y(b)) n JOIN dt v ON v.tile = n.tile AND v.r = n.rr AND v.c = n.cc GROUP BY ALL)"""
_TEXTURES = [f"text_{n}{i}" for n in "sm" for i in range(5)]


@query("pixel_features", _DATED + f", {_WINDOW(1, 's')}, {_WINDOW(2, 'm')} SELECT tile || '_' || (r * 16 + c) AS uid, tile, label AS segment_id, gt IS NOT NULL AS gt_label, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ft.SPECTRAL) + ", " + ", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in _TEXTURES) + " FROM dt JOIN ts USING (tile, r, c) JOIN tm USING (tile, r, c)")
def pixel_features(spark, sf_dir):
    """All 30 features of every pixel."""
    found = ft.pixel_features(cube_pixels(spark, sf_dir), 15)
    return found.select("uid", "tile", "segment_id", "gt_label", *[stable(c).alias(c) for c in ft.SPECTRAL], *[stable(c, 4).alias(c) for c in _TEXTURES])


def _segments(method, height):
    def run(spark, sf_dir):
        return search.segmented(cube_pixels(spark, sf_dir), {"segment_method": method, "height": height, "least": 6})

    return run


for _name, (_method, _height) in {"segments_dynamics": ("dynamics_hcut", 0.05), "segments_combined": ("combined_hcut", 0.1), "segments_compact_energy": ("compact_energy_cut", 0.02), "segments_mumford_shah": ("ms_energy_cut", 0.01)}.items():
    query(_name)(_segments(_method, _height))


def _gradient(method):
    def run(spark, sf_dir):
        def tile(frame: pd.DataFrame) -> pd.DataFrame:
            found = gradients.combined_gradient(search.cube_of(frame), method)
            return frame[["tile", "r", "c"]].assign(gradient=found[frame.r, frame.c])

        return per_tile(cube_pixels(spark, sf_dir).select("tile", "r", "c", *ft.BANDS), tile, "tile bigint, r bigint, c bigint, gradient double")

    return run


for _method in gradients.STRATEGIES:
    query(f"gradient_{_method}")(_gradient(_method))


@query("adaptive_contrast")
def adaptive_contrast(spark, sf_dir):
    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        values = grid(frame, "value", 0.0)
        span = np.ptp(values)
        found = gradients.adaptive_contrast((values - values.min()) / (span or 1), 8)
        return frame[["tile", "r", "c"]].assign(grey=found[frame.r, frame.c])

    return per_tile(pixels(spark, sf_dir).select("tile", "r", "c", "value"), tile, "tile bigint, r bigint, c bigint, grey double")


@query("segmentation_scores")
def segmentation_scores(spark, sf_dir):
    """Boundary scores and loss by tile of segments under the default settings."""
    px = cube_pixels(spark, sf_dir)
    scores = search.tile_scores(px, search.segmented(px, {"least": 6, "height": 0.05}))
    return scores.select("tile", *[stable(c).alias(c) for c in ("precision", "recall", "f1", "f1_w", "loss")])


@query("simplified_segments")
def simplified_segments(spark, sf_dir):
    """True labels drawn anew from outlines without steps of one pixel."""

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        labels = grid(frame.assign(gt=frame["gt"].fillna(0)), "gt", 0).astype(int)
        return frame[["tile", "r", "c"]].assign(label=segmentation.smoothed_labels(labels, 1.0)[frame.r, frame.c])

    return per_tile(pixels(spark, sf_dir).select("tile", "r", "c", "gt"), tile, "tile bigint, r bigint, c bigint, label bigint")


@query("region_polygons")
def region_polygons(spark, sf_dir):
    """Outlines of the true labels as polygons in text form, dissolved by label."""

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        labels = grid(frame, "gt", 0).astype(int)
        rows = [(frame.tile.iloc[0], int(v), segmentation.polygon_text(labels == v)) for v in np.unique(labels[labels > 0])]
        return pd.DataFrame(rows, columns=["tile", "label", "polygon"])

    return per_tile(pixels(spark, sf_dir).where("gt IS NOT NULL").select("tile", "r", "c", "gt"), tile, "tile bigint, label bigint, polygon string")


@query("boundary_points")
def boundary_points(spark, sf_dir):
    """Points every 2.5 pixels along the outer outlines of the true labels."""

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        labels = grid(frame, "gt", 0).astype(int)
        parts = [(int(v), p) for v in np.unique(labels[labels > 0]) for p in segmentation.boundary_points(labels == v)]
        return pd.DataFrame([(frame.tile.iloc[0], v, *p) for v, p in parts], columns=["tile", "label", "r", "c"])

    return per_tile(pixels(spark, sf_dir).where("gt IS NOT NULL").select("tile", "r", "c", "gt"), tile, "tile bigint, label bigint, r double, c double")


@query("subset_selection")
def subset_selection(spark, sf_dir):
    """Five subsets of each size from 25,000 trials a size, over the tiles of the field view and four of their
    statistics; sizes that the tiles have no room for are left out. The view has fifty tiles at any scale."""
    stats = fields(spark, sf_dir).groupBy(F.col("tile_id").alias("tile")).agg(F.avg("area").alias("area"), F.avg("n_lines").alias("lines"), (F.sum("agri") / F.sum("area")).alias("agri"), F.count("*").cast("double").alias("count"))
    columns = ["area", "lines", "agri", "count"]
    tiles = scaled(stats, columns, "minmax").orderBy("tile").toPandas()
    found = sub.choose_subsets(spark, tiles, columns, [10, 50, 100, 250, 1000, 4000])
    return found.withColumn("tile_list", F.array_join("tile_list", ","))


@query("rf_object_segments")
def rf_object_segments(spark, sf_dir):
    """A forest of 100 trees that see a twentieth of the 65 features, on segments; trained on four of five
    groups of tiles, applied to all."""
    found = ft.object_features(cube_pixels(spark, sf_dir)).withColumn("y", F.col("gt_label").cast("int"))
    data = found.select("uid", "tile", "y", F.array("area", *_NUMBERS).cast("array<double>").alias("features"))
    model = models.train_forest(data.where("tile % 5 <> 0").fillna(0.0), "features", "y")
    return models.predict(model, data, "features").select("uid", "y", "prediction", F.round("p", 6).alias("p"))


@query("tile_evaluation")
def tile_evaluation(spark, sf_dir):
    """Raster and object metrics of every tile under their public names, as one table."""
    return ev.Evaluator(pixels(spark, sf_dir)).by_tile()
