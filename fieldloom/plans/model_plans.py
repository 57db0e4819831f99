"""Queries that train and apply models; checked by their tests, as SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import models
from fieldloom.operators.features import BANDS, band_features
from fieldloom.plans.catalogue import query
from fieldloom.sources.views import cube, table


@query("rf_segments")
def rf_segments(spark, sf_dir):
    """A forest that tells even from odd classes by the 20 temporal features; trained on four of five folds, with 100
    trees that see a twentieth of the features."""
    kinds = ("max", "min", "rise", "fall")
    data = band_features(cube(spark, sf_dir)).select("id", (F.col("label") % 2).alias("y"), F.array(*[f"{b}_{k}" for k in kinds for b in BANDS]).alias("features"))
    model = models.train_forest(data.where("id % 5 <> 0"), "features", "y")
    return models.predict(model, data, "features").select("id", "y", "prediction", F.round("p", 6).alias("p"))


@query("weighted_accuracy", """WITH w AS (SELECT CAST(l_quantity AS DOUBLE) AS w, l_returnflag = 'R' AS y, l_linestatus = 'F' AS p FROM lineitem)
SELECT round(sum(CASE WHEN y = p THEN w ELSE 0 END) / sum(w) + 1e-9, 6) AS accuracy, round(2 * sum(CASE WHEN y AND p THEN w ELSE 0 END) / (2 * sum(CASE WHEN y AND p THEN w ELSE 0 END) + sum(CASE WHEN y <> p THEN w ELSE 0 END)) + 1e-9, 6) AS f1 FROM w""")
def weighted_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("w"), (F.col("l_returnflag") == "R").alias("y"), (F.col("l_linestatus") == "F").alias("p"))
    return models.weighted_score(rows, "w", "y", "p").select(F.round(F.col("accuracy") + 1e-9, 6).alias("accuracy"), F.round(F.col("f1") + 1e-9, 6).alias("f1"))
