"""Segment classification with Spark ML, and Bayesian search of kernel settings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Add a weight that gives every class the same total, from one aggregation of the classes."""
    counts = df.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    weights = counts.groupBy().agg(F.sum("__n").alias("all"), F.collect_list(F.struct("__label", "__n")).alias("classes"))  # a row for each class
    weights = weights.select(F.explode("classes").alias("k"), (F.col("all") / F.size("classes")).alias("share")).select("k.__label", (F.col("share") / F.col("k.__n")).alias("weight"))
    return df.join(F.broadcast(weights), F.col(label) == F.col("__label")).drop("__label")


def train_forest(df: DataFrame, features: str, label: str, trees: int = 100, subset: str = "0.05", seed: int = 42):
    """A random forest on balanced classes; `features` is an array column.

    The copy that is returned has no training summary, which holds the session: with it no model can be
    sent to tasks once the session has had an Observation."""
    ready = balanced(df, label).withColumn("vector", array_to_vector(features)).withColumn("label_", F.col(label).cast("double"))
    return RandomForestClassifier(featuresCol="vector", labelCol="label_", weightCol="weight", numTrees=trees, featureSubsetStrategy=subset, maxDepth=10, seed=seed).fit(ready).copy()


def predict(model, df: DataFrame, features: str) -> DataFrame:
    """Add prediction and the probability of class 1."""
    out = model.transform(df.withColumn("vector", array_to_vector(features)))
    return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("vector", "rawPrediction", "probability")


def segment_vote(df: DataFrame, keys: list[str]) -> DataFrame:
    """Majority of the pixels' predictions (a tie is false)."""
    return df.groupBy(*keys).agg((F.avg("prediction") > 0.5).alias("is_field"))


def weighted_score(df: DataFrame, weight: str, truth: str, guess: str) -> DataFrame:
    """Accuracy and F1 by weight; F1 without positives is zero."""
    w, y, p = F.col(weight), F.col(truth), F.col(guess)
    s = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    sums = df.agg(s(y == p).alias("ok"), F.sum(w).alias("all"), s(y & p).alias("tp"), s(y != p).alias("off"))
    return sums.select((F.col("ok") / F.col("all")).alias("accuracy"), F.when(F.col("tp") + F.col("off") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("off"))).otherwise(0.0).alias("f1"))


def minimise(objective, bounds: list[tuple[float, float]], calls: int = 30, initial: int = 10, seed: int = 0) -> tuple[list[float], float, list[float]]:
    """Gaussian-process search with expected improvement: (best point, best value, all values).

    Each evaluation of the objective may be a Spark job; the process itself is a few rows on the driver."""
    rng = np.random.default_rng(seed)
    low, size = np.array([b[0] for b in bounds]), np.array([b[1] - b[0] for b in bounds])
    cells = np.array([rng.permutation(initial) for _ in bounds]).T
    x = (cells + rng.random((initial, len(bounds)))) / initial  # a Latin hypercube
    y = [objective((low + p * size).tolist()) for p in x]
    kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(axis=2) / 0.2**2)
    while len(y) < calls:
        values = np.array(y)
        scaled = (values - values.mean()) / (values.std() or 1)
        inverse = np.linalg.inv(kernel(x, x) + 1e-4 * np.eye(len(x)))
        tries = rng.random((2000, len(bounds)))
        cross = kernel(tries, x)
        mean = cross @ inverse @ scaled
        spread = np.sqrt(np.maximum(1e-12, 1 - np.einsum("ij,jk,ik->i", cross, inverse, cross)))
        z = (scaled.min() - mean) / spread
        cdf = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
        gain = spread * (z * cdf + np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi))
        x = np.vstack([x, tries[gain.argmax()]])
        y.append(objective((low + x[-1] * size).tolist()))
    best = int(np.argmin(y))
    return (low + x[best] * size).tolist(), y[best], y
