"""Segmentation of tiles under a set of parameters, its loss, and searches over parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import evaluation as ev
from fieldloom.operators import gradients, models, segmentation
from fieldloom.operators.features import BANDS
from fieldloom.operators.kernels import grid
from fieldloom.operators.relational import mean_loss

#: What the search may set, and what it is without.
DEFAULTS = {"preprocess": None, "grad_method": "post_avg_soft", "sigma": 1.0, "hysteresis": 0.2, "segment_method": "dynamics_hcut", "height": 0.1, "least": 25, "weight": 0.5, "epsilon": 0.0}


def cube_of(frame: pd.DataFrame) -> np.ndarray:
    """(band, date, row, column) of a tile; missing pixels are zero."""
    out = []
    for band in BANDS:
        dates = np.stack(frame[band].to_numpy())
        layers = []
        for t in range(dates.shape[1]):
            layers.append(grid(frame.assign(__v=dates[:, t]), "__v", 0.0))
        out.append(np.stack(layers))
    return np.stack(out)


def enhanced(cube: np.ndarray, method: str | None) -> np.ndarray:
    """Contrast of every layer enhanced: 'FHH' by fuzzy hyperbolisation, 'CLAHE' by adaptive equalisation."""
    if method is None:
        return cube
    low, high = (f(cube, axis=(2, 3), keepdims=True) for f in (np.min, np.max))
    scaled = np.divide(cube - low, high - low, out=np.zeros(cube.shape), where=high > low)
    if method == "FHH":
        return (np.exp(-(scaled**0.8)) - 1) / (np.exp(-1) - 1)
    if method == "CLAHE":
        return np.stack([np.stack([gradients.adaptive_contrast(x) for x in band]) for band in scaled])
    raise ValueError(f"unknown method {method}")


def segment_tile(cube: np.ndarray, settings: dict) -> np.ndarray:
    """Contrast, edges, cut and simplification of one tile."""
    p = DEFAULTS | settings
    cube = enhanced(cube, p["preprocess"])
    edges = gradients.combined_gradient(cube, p["grad_method"], p["sigma"], 0.3 * p["hysteresis"], p["hysteresis"])
    labels = segmentation.segment(edges, p["segment_method"], p["height"], p["least"], cube[4].mean(axis=0), p["weight"])
    return segmentation.smoothed_labels(labels, p["epsilon"]) if p["epsilon"] > 0 else labels


def segmented(px: DataFrame, settings: dict) -> DataFrame:
    """(tile, r, c, segment) of tiles with the five band arrays; one task a tile."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        labels = segment_tile(cube_of(frame), settings)
        return pd.DataFrame({"tile": frame.tile, "r": frame.r, "c": frame.c, "segment": labels[frame.r, frame.c]})

    return px.select("tile", "r", "c", *BANDS).groupBy("tile").applyInPandas(run, "tile long, r long, c long, segment long")


def tile_scores(px: DataFrame, segments: DataFrame) -> DataFrame:
    """Boundary scores of segments by tile, with the loss -(f1 + f1_w) / 2 (null if either is)."""
    both = px.select("tile", "r", "c", "gt").join(segments.withColumnRenamed("segment", "pred"), ["tile", "r", "c"])
    counts = ev.balanced_f1(ev.confusion(ev.rastered(both), F.col("gb"), F.col("pb"), ["tile"]))
    return counts.withColumn("loss", -(F.coalesce("f1", F.lit(0.0)) + F.col("f1_w")) / 2)


def objective(px: DataFrame, settings: dict) -> float:
    """Mean loss over tiles, where an undefined one is zero."""
    scores = tile_scores(px, segmented(px, settings))
    return float(scores.agg(F.coalesce(mean_loss("loss"), F.lit(0.0))).first()[0])


def search_settings(px: DataFrame, bounds: dict[str, tuple[float, float]], fixed: dict, calls: int = 100, initial: int = 64, seed: int = 0) -> tuple[dict, float]:
    """Best settings of a Gaussian-process search; each call is one job over all tiles."""
    names = list(bounds)
    point, value, _ = models.minimise(lambda x: objective(px, fixed | dict(zip(names, x))), [bounds[n] for n in names], calls, initial, seed)
    return fixed | dict(zip(names, point)), value


def grid_search(df: DataFrame, features: str, label: str, fold: str, subsets: list[str], trees: int = 100) -> DataFrame:
    """(subset, accuracy, f1): mean scores of forests over folds for each share of features a tree may see."""
    spark = df.sparkSession
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]  # a few numbers
    rows = []
    for subset in subsets:
        for k in folds:
            model = models.train_forest(df.where(F.col(fold) != k), features, label, trees, subset)
            found = models.predict(model, df.where(F.col(fold) == k), features)
            found = found.select(F.lit(1.0).alias("w"), (F.col(label) > 0).alias("y"), (F.col("prediction") > 0).alias("p"))
            score = models.weighted_score(found, "w", "y", "p").first()
            rows.append((subset, k, score.accuracy, score.f1))
    return spark.createDataFrame(rows, f"subset string, fold {df.schema[fold].dataType.simpleString()}, accuracy double, f1 double").groupBy("subset").agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))
