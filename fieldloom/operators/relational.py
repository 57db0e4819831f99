"""Table operations of dataset curation: header groups, alignment, lookups, class columns, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalar import row_sum


def without_groups(df: DataFrame, *groups: str) -> DataFrame:
    """Drop the struct columns of the named header groups and flatten the others to their second-level names."""
    return df.select(*[F.col(f"{c}.*") for c in df.columns if c not in groups])


def meta_first(df: DataFrame, meta: list[str]) -> DataFrame:
    """The named columns before all others, each moved to the front in turn, so that they end up reversed."""
    return df.select(*reversed(meta), *[c for c in df.columns if c not in meta])


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two tables side by side by their keys, as a full outer join."""
    return left.join(right, keys, "full")


def reindexed(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """A row for each of the given keys, null where the table has none."""
    return keys.join(df, on, "left")


def coregistered(fine: DataFrame, coarse: DataFrame, step: int) -> DataFrame:
    """Give each fine cell (tile, r, c) the value of the nearest coarse cell centre, of which there is one
    every `step` cells from 0; a cell half way takes the later one if there is one, else the earlier.

    An equi-join on cell numbers, with the extent of each tile's coarse raster as the clip."""
    last = coarse.groupBy("tile").agg(F.max("cr").alias("last_r"), F.max("cc").alias("last_c"))
    near = lambda x, most: F.least(F.floor(F.col(x) / step + 0.5), F.col(most))
    placed = fine.join(last, "tile").withColumn("cr", near("r", "last_r")).withColumn("cc", near("c", "last_c")).drop("last_r", "last_c")
    return placed.join(coarse, ["tile", "cr", "cc"], "left").drop("cr", "cc")


def annotated_images(images: DataFrame, annotations: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every image with the list of its annotations in the order of their fields, empty if it has none."""
    listed = F.sort_array(F.collect_list(F.struct(*fields))).alias("annotations")
    return images.join(annotations.groupBy(key).agg(listed), key, "left").withColumn("annotations", F.coalesce("annotations", F.array()))


def field_quality(fields: DataFrame, area: float, width: float, solidity: float, euler: int, classes: list[str], most: float) -> DataFrame:
    """Fields that pass all five bounds: area and minor axis and solidity over theirs, Euler number
    and the sum over excluded classes (null: zero) at most theirs."""
    return fields.where(
        (F.col("area") > area) & (F.col("axis_minor") > width) & (F.col("solidity") > solidity) & (F.col("euler_8") <= euler) & (row_sum(*classes) <= most)
    )


def tile_filter(fields: DataFrame, classes: list[str], pixels: int, agri: float, share: float, count: int) -> DataFrame:
    """Tiles whose share of the given classes in the field area, share of field area in all pixels,
    and number of fields reach their bounds. One aggregation: each bound keeps or drops whole tiles."""
    covered = F.coalesce(F.sum(row_sum(*classes)), F.lit(0)) / F.sum("area")
    tiles = fields.groupBy("tile_id").agg(F.count("*").alias("n_fields"), covered.alias("agri_share"), (F.sum("area") / pixels).alias("field_share"))
    return tiles.where((F.col("agri_share") >= agri) & (F.col("field_share") >= share) & (F.col("n_fields") >= count))


def digest(*parts: Column | str) -> Column:
    """A mixing hash that any engine with MD5 computes alike; seeds give independent orders."""
    return F.md5(F.concat_ws(":", *parts))


def first_by(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their places. Spark cuts each group in the tasks before
    the shuffle, as the filter on the place is part of the window."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def segment_subset(pixels: DataFrame, segment: str, n: int, seed: int) -> DataFrame:
    """All pixels of at most n segments, drawn without replacement by a seeded hash."""
    drawn = pixels.select(segment).distinct().where(F.col(segment).isNotNull()).orderBy(digest(F.col(segment).cast("string"), F.lit(str(seed))), segment).limit(n)
    return pixels.join(drawn, segment, "left_semi")


def valid_annotations(boxes: DataFrame, width: int, height: int, known: list) -> DataFrame:
    """Boxes (x, y, w, h, area, ignore, category) that are not ignored, meet the image, have an area
    and sides of at least one, and a known category."""
    inside = F.greatest(F.lit(0), F.least(F.col("x") + F.col("w"), F.lit(width)) - F.greatest("x", F.lit(0))) * F.greatest(
        F.lit(0), F.least(F.col("y") + F.col("h"), F.lit(height)) - F.greatest("y", F.lit(0))
    )
    return boxes.where(~F.coalesce(F.col("ignore"), F.lit(False)) & (inside != 0) & (F.col("area") > 0) & (F.col("w") >= 1) & (F.col("h") >= 1) & F.col("category").isin(known))


def usable_images(images: DataFrame, annotations: DataFrame, key: str, min_size: int, test_mode: bool = False) -> DataFrame:
    """Images with annotations whose shorter side reaches the bound; all of them in test mode."""
    if test_mode:
        return images
    return images.where(F.least("width", "height") >= min_size).join(annotations, key, "left_semi")


def filtered_bands(px: DataFrame, good: DataFrame) -> DataFrame:
    """Label bands of the kept fields: enumeration null, extent and distance zero elsewhere, and the
    boundary drawn anew. `good` has (tile, gt)."""
    from fieldloom.operators.neighbourhood import boundary

    kept = px.join(good.select("tile", "gt", F.lit(True).alias("__good")), ["tile", "gt"], "left")
    kept = kept.withColumn("gt", F.when(F.col("__good"), F.col("gt"))).drop("__good")
    kept = kept.withColumns({b: F.when(F.col("gt").isNotNull(), F.col(b)).otherwise(0) for b in ("extent", "dist")})
    return boundary(kept.repartition("tile"), "gt", "bound")


def balanced_group_folds(sizes: DataFrame, group: str, size: str, folds: int, repeats: int) -> DataFrame:
    """(repeat, group, fold): whole groups dealt to folds of nearly equal size.

    Groups go in order of falling size to the fold with the fewest rows so far. Equals, and as many
    neighbours in that order as there are folds, are ordered by a hash that changes with the repeat, so
    that repeats differ where no sizes are equal. Only sizes of groups are dealt, one task a repeat."""
    import pandas as pd

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        load, out = [0] * folds, []
        frame = frame.sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
        frame = frame.assign(row=frame.index // folds).sort_values(["row", "h"])
        for n in frame["n"]:
            best = min(range(folds), key=lambda k: (load[k], k))
            load[best] += n
            out.append(best)
        return frame.assign(fold=out)[["repeat", group, "fold"]]

    kind = sizes.schema[group].dataType.simpleString()
    again = sizes.select(F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"), group, F.col(size).alias("n"))
    again = again.withColumn("h", digest(F.col(group).cast("string"), F.col("repeat").cast("string")))
    return again.groupBy("repeat").applyInPandas(deal, f"repeat int, {group} {kind}, fold int")


def train_test_rows(df: DataFrame, folds: DataFrame, group: str, n: int) -> DataFrame:
    """Every row for every (repeat, fold), marked as test if its group is in the fold, else train."""
    out = df.join(folds, group).withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("is_test", F.col("own") == F.col("fold")).drop("own")


def mean_loss(loss: str) -> Column:
    """Mean in which a null or undefined loss counts as zero."""
    return F.avg(F.coalesce(F.nanvl(F.col(loss).cast("double"), F.lit(None).cast("double")), F.lit(0.0)))


def mean_precision(precision: str) -> Column:
    """Mean of the precisions that are defined (over -1)."""
    return F.avg(F.when(F.col(precision) > -1, F.col(precision)))


def mask_iou_target(pred: Column, truth: Column, threshold: float = 0.5) -> Column:
    """Overlap by union of two mask arrays, the prediction binarised; null if both are empty."""
    pairs = F.zip_with(F.transform(pred, lambda x: (x >= threshold).cast("int")), F.transform(truth, lambda x: (x > 0).cast("int")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.aggregate(pairs, F.lit(0), lambda s, x: s + x["a"] * x["b"])
    either = F.aggregate(pairs, F.lit(0), lambda s, x: s + F.greatest(x["a"], x["b"]))
    return F.when(either > 0, both / either)


def net_input(x: Column) -> Column:
    """Values of [-1, 1] as whole numbers of [0, 255]; values beyond are clipped, null counts as -1."""
    return F.floor(255 * F.greatest(F.least(F.coalesce(x, F.lit(-1.0)) * 0.5 + 0.5, F.lit(1.0)), F.lit(0.0))).cast("int")


def box_centre(box: str) -> tuple[Column, Column]:
    return F.col(f"{box}.x0") + F.col(f"{box}.w") / 2, F.col(f"{box}.y0") + F.col(f"{box}.h") / 2


def run_name(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def coco_document(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """(key, document): one JSON object for each image with its annotations in order of their id."""
    listed = F.sort_array(F.collect_list(F.struct("id", "category_id", "bbox", "area"))).alias("annotations")
    return images.join(annotations.groupBy(key).agg(listed), key).select(key, F.to_json(F.struct(F.col(key).alias("image_id"), "annotations")).alias("document"))
