"""Temporal features of pixels: arg-max dates, values at those dates, and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalar import argmax, argmin, lag_differences

BANDS = ("blue", "green", "red", "nir", "ndvi")


def band_features(cube: DataFrame) -> DataFrame:
    """For each row the dates of highest and lowest NDVI and of its largest rise and fall over two
    dates (the date between), and all five bands at each of the four: 20 features, 4 dates."""
    rises = lag_differences(F.col("ndvi"))
    dates = {"max": argmax(F.col("ndvi")), "min": argmin(F.col("ndvi")), "rise": argmax(rises) + 1, "fall": argmin(rises) + 1}
    out = cube.withColumns({f"at_{k}": v.cast("int") for k, v in dates.items()})
    return out.withColumns({f"{b}_{k}": F.get(b, F.col(f"at_{k}")) for k in dates for b in BANDS})


#: Bands and dates of the classification features: at the highest red, the lowest and highest index, and the
#: dates between which the index rises and falls most.
FEATURE_BANDS = ("green", "red", "nir", "ndvi")
DATES = ("max_red", "min_ndvi", "max_ndvi", "max_ndvi_incr", "max_ndvi_decr")
SPECTRAL = [f"{b}_{d}" for b in FEATURE_BANDS for d in DATES]
INDEX = SPECTRAL[15:]
FEATURE_SETS = ("spec", "geom", "text", "neighbor")


def dated_bands(cube: DataFrame) -> DataFrame:
    """The 20 spectral features of each row: four bands at five dates."""
    rises = lag_differences(F.col("ndvi"))
    dates = {"max_red": argmax(F.col("red")), "min_ndvi": argmin(F.col("ndvi")), "max_ndvi": argmax(F.col("ndvi")), "max_ndvi_incr": argmax(rises) + 1, "max_ndvi_decr": argmin(rises) + 1}
    out = cube.withColumns({f"__{k}": v.cast("int") for k, v in dates.items()})
    out = out.withColumns({f"{b}_{d}": F.get(b, F.col(f"__{d}")) for b in FEATURE_BANDS for d in DATES})
    return out.drop(*[f"__{d}" for d in DATES])


def _entropies(px: DataFrame) -> DataFrame:
    """(tile, label, entropy_*): entropy of each index layer in 100 bins of [-1, 1], by one aggregation of all layers."""
    from fieldloom.operators.neighbourhood import entropy

    layers = F.explode(F.array(*[F.struct(F.lit(c.replace("ndvi_", "", 1)).alias("layer"), F.col(c).alias("value")) for c in INDEX])).alias("x")
    found = entropy(px.select("tile", "label", layers).select("tile", "label", "x.*"), ["tile", "label", "layer"], F.col("value"))
    return found.groupBy("tile", "label").agg(*[F.max(F.when(F.col("layer") == d, F.col("entropy"))).alias(f"entropy_{d}") for d in DATES])


def object_features(px: DataFrame, feature_set: tuple[str, ...] = FEATURE_SETS) -> DataFrame:
    """One row per segment: uid, tile, segment_id, gt_label, area and up to 65 features.

    px: tile, r, c, label, is_field (0 or 1) and the five band arrays. A feature set is a beginning of
    spec, geom, text, neighbor, anything else is an error. All sets are aggregations by (tile, label):
    mean layers; area and Hu moments; entropy and deviation of the index layers; number, means and
    deviations of 13 values of the adjacent segments."""
    from fieldloom.operators import shapes
    from fieldloom.operators.neighbourhood import adjacent_pairs

    if not feature_set or tuple(feature_set) != FEATURE_SETS[: len(feature_set)]:
        raise ValueError("a feature set is a beginning of " + ", ".join(FEATURE_SETS))
    key = ["tile", "label"]
    px = dated_bands(px.where(F.col("label").isNotNull()))
    text = [F.stddev_pop(c).alias(f"stdv_{c.replace('ndvi_', '', 1)}") for c in INDEX] if len(feature_set) > 2 else []
    out = px.groupBy(*key).agg((F.avg("is_field") > 0.5).alias("gt_label"), F.count("*").alias("area"), *[F.avg(c).alias(c) for c in SPECTRAL], *text)
    if len(feature_set) > 1:
        out = out.join(shapes.hu_moments(px.select(*key, "r", "c")), key)
    if len(feature_set) > 2:
        out = out.join(_entropies(px), key)
    if len(feature_set) > 3:
        values = [*INDEX, "area", "hu_1", "hu_2", *[f"entropy_{d}" for d in DATES]]
        pairs = adjacent_pairs(px, "label")
        both = pairs.union(pairs.select("tile", "b", "a")).toDF("tile", "label", "other")
        near = both.join(out.select("tile", F.col("label").alias("other"), *[F.col(v).cast("double").alias(f"v{n}") for n, v in enumerate(values)]), ["tile", "other"])
        size = F.count("*")
        mean = [F.coalesce(F.sum(f"v{n}") / size, F.lit(0.0)).alias(f"neighbours_{n + 1}") for n in range(len(values))]
        spread = [
            F.coalesce(F.sqrt(F.greatest((F.sum(F.col(f"v{n}") * F.col(f"v{n}")) - F.sum(f"v{n}") * F.sum(f"v{n}") / size) / F.greatest(size - 1, F.lit(1)), F.lit(0.0))), F.lit(0.0)).alias(f"neighbours_{n + 1 + len(values)}")
            for n in range(len(values))
        ]
        around = near.groupBy(*key).agg(size.cast("double").alias("neighbours_0"), *mean, *spread)
        out = out.join(around, key, "left").fillna(0.0, [f"neighbours_{n}" for n in range(2 * len(values) + 1)])
    return out.withColumnRenamed("label", "segment_id").withColumn("uid", F.concat_ws("_", "tile", "segment_id"))


def pixel_features(px: DataFrame, last: int) -> DataFrame:
    """One row per pixel: uid, tile, r, c, segment_id, gt_label and 30 features: the 20 spectral ones and the
    deviations of the index layers in 3 x 3 and 5 x 5 windows (text_s0 .. text_m4)."""
    from fieldloom.operators.neighbourhood import moving_std

    out = dated_bands(px)
    for size, name in ((3, "s"), (5, "m")):
        out = out.join(moving_std(out, INDEX, size, last, [f"text_{name}{n}" for n in range(5)]), ["tile", "r", "c"])
    textures = [f"text_{name}{n}" for name in "sm" for n in range(5)]
    uid = F.concat_ws("_", "tile", (F.col("r") * (last + 1) + F.col("c")).cast("string"))
    return out.select(uid.alias("uid"), "tile", "r", "c", F.col("label").alias("segment_id"), (F.col("is_field") > 0).alias("gt_label"), *SPECTRAL, *textures)
