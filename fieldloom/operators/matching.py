"""Matching of labelled objects and suppression of overlapping instances.

Overlaps are equi-joins or one aggregation over pixel keys, never theta joins over geometry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalar import box_overlap, iou, position_similarity


def contingency(px: DataFrame) -> DataFrame:
    """(tile, gt, pred, n) over pixels that have both labels: one partial aggregation."""
    return px.where("gt IS NOT NULL AND pred IS NOT NULL").groupBy("tile", "gt", "pred").agg(F.count("*").alias("n"))


def label_areas(px: DataFrame, label: str) -> DataFrame:
    return px.where(F.col(label).isNotNull()).groupBy("tile", label).agg(F.count("*").alias(f"{label}_area"))


def touching_pairs(px: DataFrame) -> DataFrame:
    """(tile, gt, pred) of labels whose pixels are equal or 8-neighbours."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    near = px.where("gt IS NOT NULL").select("tile", "gt", "r", "c", F.explode(steps).alias("s"))
    near = near.select("tile", "gt", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return near.join(px.where("pred IS NOT NULL").select("tile", "r", "c", "pred"), ["tile", "r", "c"]).select("tile", "gt", "pred").distinct()


def object_overlaps(px: DataFrame, touch: bool = False) -> DataFrame:
    """Overlapping pairs of ground truth and prediction with iou, io_ref and io_pred; with touch, also pairs that only touch."""
    pairs = contingency(px)
    if touch:
        pairs = touching_pairs(px).join(pairs, ["tile", "gt", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pairs = pairs.join(label_areas(px, "gt"), ["tile", "gt"]).join(label_areas(px, "pred"), ["tile", "pred"])
    n, a, b = F.col("n"), F.col("gt_area"), F.col("pred_area")
    return pairs.withColumns({"iou": iou(n, a, b), "io_ref": n / a, "io_pred": n / b})


def best_matches(pairs: DataFrame) -> DataFrame:
    """For each ground-truth object the pairs with its highest overlap; ties all stay."""
    best = Window.partitionBy("tile", "gt").orderBy(F.desc("iou"))
    return pairs.withColumn("rank", F.rank().over(best)).where("rank = 1").drop("rank")


def with_centroids(pairs: DataFrame, px: DataFrame) -> DataFrame:
    """Add centroid distance and position similarity."""
    for label in ("gt", "pred"):
        centre = px.where(F.col(label).isNotNull()).groupBy("tile", label).agg(F.avg("r").alias(f"{label}_r"), F.avg("c").alias(f"{label}_c"))
        pairs = pairs.join(centre, ["tile", label])
    distance = F.hypot(F.col("gt_r") - F.col("pred_r"), F.col("gt_c") - F.col("pred_c"))
    return pairs.withColumn("centroid_dist", distance).withColumn("pos_sim", position_similarity(F.col("centroid_dist"), F.col("gt_area"), F.col("pred_area")))


def suppress(inst: DataFrame, min_score: float, max_iou: float) -> DataFrame:
    """Drop every instance that a strictly higher-scored one of its tile overlaps by more than
    max_iou, whether or not that one is dropped itself. Equal scores never suppress."""
    kept = inst.where(F.col("score") > min_score).withColumn("box", F.struct("x0", "y0", "w", "h"))
    a, b = kept.alias("a"), kept.select("tile", "score", "box").alias("b")
    shared = box_overlap("a.box", "b.box")
    areas = [F.col(f"{x}.box.w") * F.col(f"{x}.box.h") for x in "ab"]
    beats = (F.col("a.tile") == F.col("b.tile")) & (F.col("b.score") > F.col("a.score")) & (iou(shared, *areas) > max_iou)
    return a.join(b, beats, "left_anti").drop("box")


def overlap_raster(inst: DataFrame) -> DataFrame:
    """(tile, r, c, n, mask_sum): pixels that boxes cover, and the sum of their numbers within the tile."""
    numbered = inst.withColumn("k", F.row_number().over(Window.partitionBy("tile").orderBy("inst")))
    rows = numbered.withColumn("r", F.explode(F.expr("sequence(y0, y0 + h - 1)"))).withColumn("c", F.explode(F.expr("sequence(x0, x0 + w - 1)")))
    return rows.groupBy("tile", "r", "c").agg(F.count("*").alias("n"), F.sum("k").alias("mask_sum"))


def inner_rings(px: DataFrame, label: str, width: int, last: int) -> DataFrame:
    """Pixels of each label that have a pixel of another label, or the outside of the tile, within
    `width` steps along a row or column: the pixel version of a ring inside the outline."""
    own = F.coalesce(F.col(label), F.lit(-1))
    windows = [Window.partitionBy("tile", "c").orderBy("r"), Window.partitionBy("tile", "r").orderBy("c")]
    near = F.lit(False)
    for step in range(1, width + 1):
        for w in windows:
            for moved in (F.lag(own, step).over(w), F.lead(own, step).over(w)):
                near = near | F.coalesce(moved != own, F.lit(True))
    return px.where(F.col("r") <= last).withColumn(f"{label}_ring", near & F.col(label).isNotNull())


def boundary_iou(px: DataFrame, pairs: DataFrame, width: int = 2, last: int = 15) -> DataFrame:
    """Add iou_boundary: the overlap of the rings of two objects by their union (on pixels, an
    approximation of rings of polygons)."""
    both = inner_rings(inner_rings(px, "gt", width, last), "pred", width, last)
    sizes = {k: both.where(f"{k}_ring").groupBy("tile", k).agg(F.count("*").alias(f"{k}_n")) for k in ("gt", "pred")}
    shared = both.where("gt_ring AND pred_ring").groupBy("tile", "gt", "pred").agg(F.count("*").alias("shared"))
    out = pairs.join(sizes["gt"], ["tile", "gt"], "left").join(sizes["pred"], ["tile", "pred"], "left").join(shared, ["tile", "gt", "pred"], "left")
    n = F.coalesce("shared", F.lit(0))
    return out.withColumn("iou_boundary", n / (F.col("gt_n") + F.col("pred_n") - n)).drop("gt_n", "pred_n", "shared")
