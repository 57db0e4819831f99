"""Evaluation of labelled rasters: pixel, boundary, clustering and instance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import neighbourhood as nb


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def rastered(px: DataFrame) -> DataFrame:
    """The pixels that raster metrics count: those of `field_mask`, with the boundaries `gb` and `pb`
    of both labels and their 2 x 2 dilations `gd` and `pd`. Dilations see the whole tile.

    One shuffle by tile serves all windows."""
    px = nb.boundary(nb.boundary(px.repartition("tile"), "gt", "gb"), "pred", "pb")
    px = nb.dilated(nb.dilated(nb.field_mask(px, "gt", "inside"), "gb", "gd", 2), "pb", "pd", 2)
    return px.where("inside").drop("inside")


def tolerant_f1(px: DataFrame) -> DataFrame:
    """(tile, f1_b): predicted boundaries near true ones against true ones near predicted ones.

    A share of nothing is 0, and the score is null if both shares are."""
    share = lambda a, b: F.coalesce(F.count_if(F.col(a) & F.col(b)) / F.nullif(F.count_if(F.col(a)), F.lit(0)), F.lit(0.0))
    shares = px.groupBy("tile").agg(share("pb", "gd").alias("p"), share("gb", "pd").alias("q"))
    return shares.select("tile", _ratio(2 * F.col("p") * F.col("q"), F.col("p") + F.col("q")).alias("f1_b"))


def confusion(df: DataFrame, gt: Column, pred: Column, group: list[str]) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of boolean columns (0/0 is null)."""
    counts = df.groupBy(*group).agg(
        F.count_if(gt & pred).alias("tp"), F.count_if(~gt & pred).alias("fp"), F.count_if(gt & ~pred).alias("fn"), F.count_if(~gt & ~pred).alias("tn")
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"accuracy": (tp + tn) / (tp + fp + fn + tn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def balanced_f1(counts: DataFrame) -> DataFrame:
    """Mean of both classes' F1 under weights that balance the classes."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    wp, wn = (fp + tn) / total, (tp + fn) / total
    f_pos = _ratio(2 * wp * tp, 2 * wp * tp + wn * fp + wp * fn)
    f_neg = _ratio(2 * wn * tn, 2 * wn * tn + wn * fp + wp * fn)
    return counts.withColumn("f1_w", (f_pos + f_neg) / 2)


def _contingency(px: DataFrame) -> DataFrame:
    """Pixels by both labels, null as a label of its own."""
    return px.groupBy("tile", F.coalesce("gt", F.lit(-1)).alias("g"), F.coalesce("pred", F.lit(-1)).alias("p")).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(px: DataFrame) -> DataFrame:
    """(tile, rand): adjusted Rand index, 1 where both labellings are trivial."""
    cells = _contingency(px)
    side = lambda k: cells.groupBy("tile", k).agg(F.sum("n").alias("n")).groupBy("tile").agg(F.sum(_pairs(F.col("n"))).alias(f"pairs_{k}"))
    both = cells.groupBy("tile").agg(F.sum(_pairs(F.col("n"))).alias("pairs"), F.sum("n").alias("total"))
    both = both.join(side("g"), "tile").join(side("p"), "tile")
    expected = F.col("pairs_g") * F.col("pairs_p") / _pairs(F.col("total"))
    most = (F.col("pairs_g") + F.col("pairs_p")) / 2
    return both.select("tile", F.when(most == expected, 1.0).otherwise((F.col("pairs") - expected) / (most - expected)).alias("rand"))


def v_measure(px: DataFrame) -> DataFrame:
    """(tile, v_measure): harmonic mean of homogeneity and completeness."""
    cells = _contingency(px)
    nln = lambda n: F.sum(F.col(n) * F.ln(n))
    side = lambda k: cells.groupBy("tile", k).agg(F.sum("n").alias("m")).groupBy("tile").agg(nln("m").alias(f"s_{k}"))
    both = cells.groupBy("tile").agg(nln("n").alias("s"), F.sum("n").alias("total")).join(side("g"), "tile").join(side("p"), "tile")
    t = F.col("total")
    h = lambda s: F.ln("total") - F.col(s) / t
    shared = h("s_g") + h("s_p") - h("s")
    homogeneity = F.when(h("s_g") > 1e-12, shared / h("s_g")).otherwise(1.0)
    completeness = F.when(h("s_p") > 1e-12, shared / h("s_p")).otherwise(1.0)
    return both.select("tile", F.when(homogeneity + completeness > 0, 2 * homogeneity * completeness / (homogeneity + completeness)).otherwise(0.0).alias("v_measure"))


#: Inclusive bounds of the size classes of objects, as areas in pixels; the first takes all.
SIZES = {"all": (0, 65536), "s": (0, 100), "m": (100, 250), "l": (250, 65536)}
THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


def matched_detections(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tile, gt, gt_area), (tile, pred, area, iou, gt_area)) of disjoint labels from one aggregation of
    the pixels; iou and gt_area are null for a detection that shares no half of a union with an object.

    Labels of a side do not overlap, so over one half the pair is the only one of both; at exactly
    one half the object takes its largest detection and the detection its lowest object."""
    cells = px.groupBy("tile", "gt", "pred").agg(F.count("*").alias("n"))
    truths = cells.where("gt IS NOT NULL").groupBy("tile", "gt").agg(F.sum("n").alias("gt_area"))
    found = cells.where("pred IS NOT NULL").groupBy("tile", "pred").agg(F.sum("n").alias("area"))
    pairs = cells.where("gt IS NOT NULL AND pred IS NOT NULL").join(truths, ["tile", "gt"]).join(found, ["tile", "pred"])
    pairs = pairs.withColumn("iou", F.col("n") / (F.col("gt_area") + F.col("area") - F.col("n"))).where("iou >= 0.5")
    by_gt = Window.partitionBy("tile", "gt").orderBy(F.desc("area"), "pred")
    by_pred = Window.partitionBy("tile", "pred").orderBy(F.desc("iou"), "gt")
    pairs = pairs.withColumn("a", F.row_number().over(by_gt)).withColumn("b", F.row_number().over(by_pred)).where("a = 1 AND b = 1")
    return truths, found.join(pairs.select("tile", "pred", "iou", "gt_area"), ["tile", "pred"], "left")


def precision_curves(truths: DataFrame, detections: DataFrame, sizes: dict[str, tuple[int, int]] = SIZES, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(size, iou_thr, ap, recall) of detections (score, area, iou, gt_area) against objects (gt_area).

    In a size class other objects are ignored, and so are detections that match them, or that match
    nothing and are of another size themselves. Detections are counted by score, threshold reached
    and areas before anything is multiplied by classes and thresholds, so what is ordered is as
    small as the set of scores. Without an object of the class both values are -1."""
    spark = detections.sparkSession
    classes = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in sizes.items()], "size string, low long, high long"))
    steps = F.broadcast(spark.createDataFrame([(t,) for t in thresholds], "iou_thr double"))
    counted = detections.groupBy("score", "area", "gt_area", "iou").agg(F.count("*").alias("n"))
    within = lambda c: F.col(c).between(F.col("low"), F.col("high"))
    matched = F.coalesce(F.col("iou") >= F.col("iou_thr"), F.lit(False))
    used = counted.crossJoin(classes).crossJoin(steps).withColumn("hit", matched).where((F.col("hit") & within("gt_area")) | (~F.col("hit") & within("area")))
    scores = used.groupBy("size", "iou_thr", "score").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    objects = truths.crossJoin(classes).where(within("gt_area")).groupBy("size").agg(F.count("*").alias("objects"))
    so_far = Window.partitionBy("size", "iou_thr").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("size", "iou_thr").orderBy(F.desc("score")).rowsBetween(0, Window.unboundedFollowing)
    curve = scores.join(F.broadcast(objects), "size").withColumns({"seen": F.sum("n").over(so_far), "tp": F.sum("hits").over(so_far)})
    curve = curve.withColumns({"recall": F.col("tp") / F.col("objects"), "precision": F.col("tp") / F.col("seen")}).withColumn("best", F.max("precision").over(onward))
    levels = F.broadcast(spark.range(101).select((F.col("id") / 100.0).alias("level")))
    reached = curve.crossJoin(levels).where("recall >= level - 1e-12").groupBy("size", "iou_thr", "level").agg(F.max("best").alias("p"))
    ap = reached.groupBy("size", "iou_thr").agg((F.sum("p") / 101).alias("ap"))
    top = curve.groupBy("size", "iou_thr").agg(F.max("recall").alias("recall"))
    out = classes.select("size").crossJoin(steps).join(objects, "size", "left").join(top, ["size", "iou_thr"], "left").join(ap, ["size", "iou_thr"], "left")
    none = F.col("objects").isNull()
    return out.select("size", "iou_thr", *[F.when(none, -1.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("ap", "recall")])


def coco_summary(curves: DataFrame) -> DataFrame:
    """The ten values of an instance evaluation in one row; -1 where nothing is defined."""
    mean = lambda c, where: F.coalesce(F.avg(F.when(where & (F.col(c) > -1), F.col(c))), F.lit(-1.0))
    size = lambda k: F.col("size") == k
    named = {"AP_IoU_0.50:0.95": mean("ap", size("all")), "AP_IoU_0.50": mean("ap", size("all") & (F.col("iou_thr") == 0.5)), "AP_IoU_0.75": mean("ap", size("all") & (F.col("iou_thr") == 0.75))}
    named |= {f"AP_IoU_{k}": mean("ap", size(k)) for k in "sml"} | {"AR_max": mean("recall", size("all"))} | {f"AR_max_{k}": mean("recall", size(k)) for k in "sml"}
    return curves.agg(*[v.alias(k) for k, v in named.items()])


def rle_runs(px: DataFrame, label: str, height: int) -> DataFrame:
    """Column-major runs of each label: tile, label, start, length (gaps and islands)."""
    at = px.where(F.col(label).isNotNull()).select("tile", F.col(label).alias("label"), (F.col("c") * height + F.col("r")).alias("at"))
    place = F.row_number().over(Window.partitionBy("tile", "label").orderBy("at"))
    runs = at.withColumn("island", F.col("at") - place).groupBy("tile", "label", "island")
    return runs.agg(F.min("at").alias("start"), F.count("*").alias("length")).drop("island")


def annotations(px: DataFrame, label: str, pixels: int) -> DataFrame:
    """Instance annotations: tile, label, area, xywh box and the score area / pixels."""
    own = px.where(F.col(label).isNotNull()).groupBy("tile", F.col(label).alias("label"))
    out = own.agg(F.count("*").alias("area"), F.min("c").alias("x"), F.min("r").alias("y"), (F.max("c") - F.min("c") + 1).alias("w"), (F.max("r") - F.min("r") + 1).alias("h"))
    return out.withColumn("score", F.col("area") / pixels)


RASTER = ("f1", "precision", "recall", "f1_w", "f1_b", "rand", "v_measure", "ssmi")
OBJECT = ("iou", "io_ref", "io_pred", "iou_boundary", "mae_gt", "mae_pred", "bde", "hausdorff_dist", "pos_sim", "centroid_dist")


class Evaluator:
    """Metrics of labelled tiles (tile, r, c, gt, pred) by their public names.

    The perceptual image distance `lpips` needs the weights of a trained network and is refused."""

    def __init__(self, px: DataFrame, metrics: tuple[str, ...] = RASTER + OBJECT, last: int = 15):
        if unknown := [m for m in metrics if m not in RASTER + OBJECT]:
            raise ValueError(f"unknown metrics {', '.join(unknown)}; known are {', '.join(RASTER + OBJECT)}")
        self.px, self.metrics, self.last = px, tuple(metrics), last

    def rasters(self) -> DataFrame:
        """One row per tile with the raster metrics that are asked for."""
        inside = rastered(self.px)
        counts = balanced_f1(confusion(inside, F.col("gb"), F.col("pb"), ["tile"])).fillna(0.0, ["f1", "precision", "recall"])
        out = counts.select("tile", *[c for c in ("f1", "precision", "recall", "f1_w") if c in self.metrics])
        for name, make in (("f1_b", tolerant_f1), ("rand", adjusted_rand), ("v_measure", v_measure)):
            if name in self.metrics:
                out = out.join(make(inside), "tile", "left")
        if "ssmi" in self.metrics:
            out = out.join(boundary_ssim(inside, self.last), "tile", "left")
        return out

    def objects(self) -> DataFrame:
        """One row per true object and best match: tile, gt, pred and the object metrics that are asked for."""
        from fieldloom.operators import matching as mt

        best = mt.with_centroids(mt.best_matches(mt.object_overlaps(self.px, touch=True)), self.px)
        if "iou_boundary" in self.metrics:
            best = mt.boundary_iou(self.px, best, last=self.last)
        if set(self.metrics) & set(OBJECT[4:8]):
            best = best.join(outline_metrics(self.px, best.select("tile", "gt", "pred")), ["tile", "gt", "pred"], "left")
        return best.select("tile", "gt", "pred", *[m for m in OBJECT if m in self.metrics])

    def by_tile(self) -> DataFrame:
        """Raster metrics with the means of the object metrics by tile."""
        objects = self.objects()
        means = objects.groupBy("tile").agg(*[F.avg(c).alias(c) for c in objects.columns[3:]])
        return self.rasters().join(means, "tile", "left")

    def aggregate(self) -> DataFrame:
        """(metric, value): mean of each raster metric over tiles and of each object metric over objects; null is left out."""
        parts = []
        for df, skip in ((self.rasters(), 1), (self.objects(), 3)):
            if df.columns[skip:]:
                means = df.agg(*[F.avg(c).alias(c) for c in df.columns[skip:]])
                parts.append(means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in means.columns])).alias("x")).select("x.*"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def boundary_ssim(inside: DataFrame, last: int) -> DataFrame:
    """(tile, ssmi): structural similarity of the two boundary images, zero outside the counted pixels."""
    import numpy as np
    import pandas as pd

    from fieldloom.operators import kernels as k

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        gt, pred = np.zeros((2, last + 1, last + 1))
        gt[frame.r, frame.c], pred[frame.r, frame.c] = frame.gb, frame.pb
        return pd.DataFrame({"tile": [frame.tile.iloc[0]], "ssmi": [k.ssim(gt, pred, span=1.0)]})

    return inside.select("tile", "r", "c", F.col("gb").cast("double").alias("gb"), F.col("pb").cast("double").alias("pb")).groupBy("tile").applyInPandas(run, "tile bigint, ssmi double")


def outline_metrics(px: DataFrame, pairs: DataFrame, step: float = 2.5) -> DataFrame:
    """(tile, gt, pred, mae_gt, mae_pred, bde, hausdorff_dist) of matched objects: distances between points
    along one outline and the other outline, by cogrouping the pixels and the pairs of a tile."""
    import numpy as np
    import pandas as pd

    from fieldloom.operators import kernels as k
    from fieldloom.operators import segmentation as sg

    columns = ["tile", "gt", "pred", "mae_gt", "mae_pred", "bde", "hausdorff_dist"]

    def run(frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frame) and len(wanted):
            gt, pred = (np.nan_to_num(k.grid(frame, c), nan=-1) for c in ("gt", "pred"))
            for a, b in zip(wanted["gt"], wanted["pred"]):
                there, back, far = sg.outline_distances(gt == a, pred == b, step)
                rows.append((wanted.tile.iloc[0], a, b, there, back, (there + back) / 2, far))
        return pd.DataFrame(rows, columns=columns)

    pairs = pairs.toDF("tile", "gt", "pred")  # under names of its own, as both sides come from the pixels
    both = px.select("tile", "r", "c", "gt", "pred").groupBy("tile").cogroup(pairs.groupBy("tile"))
    return both.applyInPandas(run, "tile bigint, gt bigint, pred bigint, mae_gt double, mae_pred double, bde double, hausdorff_dist double")


def evaluation_tables(px: DataFrame, last: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three levels of an evaluation: pixel scores over all tiles, one row per matched object, and the
    instance summary (scores of detections are their areas)."""
    field, found = (F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("gt", "pred"))
    pixel = confusion(px.withColumns({"__g": field, "__p": found}), F.col("__g"), F.col("__p"), [])
    truths, detections = matched_detections(px)
    return pixel, Evaluator(px, OBJECT, last).objects(), coco_summary(precision_curves(truths, detections.withColumn("score", F.col("area"))))
