"""Queries that run a numpy kernel on each tile. SQL cannot express most; tests hold them against
worked examples."""

from __future__ import annotations

import numpy as np
import pandas as pd

from fieldloom.operators import evaluation as ev
from fieldloom.operators import gradients as g
from fieldloom.operators import kernels as k
from fieldloom.operators import matching as mt
from fieldloom.plans.catalogue import query
from fieldloom.sources.views import PX, pixels


def _long(frame: pd.DataFrame, **arrays) -> pd.DataFrame:
    out = frame[["tile", "r", "c"]].copy()
    for name, a in arrays.items():
        out[name] = a[frame.r, frame.c]
    return out


def canny_tile(frame: pd.DataFrame) -> pd.DataFrame:
    return _long(frame, gradient=g.canny_strength(k.grid(frame, "value", 0.0), 1.0, 0.3, 0.9))


@query("canny_gradient")
def canny_gradient(spark, sf_dir):
    """The gradient magnitude on edges, zero elsewhere."""
    return k.per_tile(pixels(spark, sf_dir), canny_tile, "tile bigint, r bigint, c bigint, gradient double")


def watershed_tile(frame: pd.DataFrame) -> pd.DataFrame:
    gradient = k.sobel(k.gaussian(k.grid(frame, "value", 0.0), 1.0))[2]
    return _long(frame, segment=k.watershed_cut(gradient, 20.0, 4))


@query("watershed_cut")
def watershed_cut(spark, sf_dir):
    return k.per_tile(pixels(spark, sf_dir), watershed_tile, "tile bigint, r bigint, c bigint, segment bigint")


def component_tile(frame: pd.DataFrame) -> pd.DataFrame:
    return _long(frame, component=k.components(k.grid(frame, "value", 0.0) > 40))


@query("connected_components", f"""WITH RECURSIVE {PX}, m AS (SELECT tile, r, c, r * 16 + c AS k FROM px WHERE value > 40),
reach AS (SELECT tile, r, c, k FROM m UNION SELECT b.tile, b.r, b.c, a.k FROM reach a JOIN m b ON a.tile = b.tile AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
least_ AS (SELECT tile, r, c, min(k) AS k FROM reach GROUP BY tile, r, c)
SELECT px.tile, px.r, px.c, coalesce(d.n, 0) AS component FROM px LEFT JOIN (SELECT tile, r, c, dense_rank() OVER (PARTITION BY tile ORDER BY k) AS n FROM least_) d USING (tile, r, c)""")
def connected_components(spark, sf_dir):
    return k.per_tile(pixels(spark, sf_dir), component_tile, "tile bigint, r bigint, c bigint, component bigint")


def shapes_tile(frame: pd.DataFrame) -> pd.DataFrame:
    labels = k.grid(frame, "gt", np.nan)
    rows = []
    for label in np.unique(labels[~np.isnan(labels)]):
        mask = labels == label
        major, minor, eccentricity = k.axis_lengths(mask)
        rows.append((frame.tile.iloc[0], int(label), int(mask.sum()), major, minor, eccentricity, mask.sum() / k.hull_area(mask), k.euler_number(mask, False), k.euler_number(mask, True), *k.hu_moments(mask)))
    return pd.DataFrame(rows, columns=_SHAPES)


_SHAPES = ["tile", "label", "area", "axis_major", "axis_minor", "eccentricity", "solidity", "euler_4", "euler_8", *[f"hu_{n}" for n in range(1, 8)]]


@query("region_shape")
def region_shape(spark, sf_dir):
    schema = "tile bigint, label bigint, area bigint, axis_major double, axis_minor double, eccentricity double, solidity double, euler_4 bigint, euler_8 bigint, " + ", ".join(f"hu_{n} double" for n in range(1, 8))
    return k.per_tile(pixels(spark, sf_dir).where("gt IS NOT NULL"), shapes_tile, schema)


@query("object_edge_metrics")
def object_edge_metrics(spark, sf_dir):
    """Boundary distances of the best matches, from points along the objects' outlines."""
    px = pixels(spark, sf_dir)
    return ev.outline_metrics(px, mt.best_matches(mt.object_overlaps(px)).select("tile", "gt", "pred"))


def ssim_tile(frame: pd.DataFrame) -> pd.DataFrame:
    a, b = (np.nan_to_num(k.grid(frame, c, 0.0)) for c in ("gt", "pred"))
    return pd.DataFrame({"tile": [frame.tile.iloc[0]], "ssmi": [k.ssim(a, b, span=16.0)]})


@query("tile_ssim")
def tile_ssim(spark, sf_dir):
    return k.per_tile(pixels(spark, sf_dir), ssim_tile, "tile bigint, ssmi double")
