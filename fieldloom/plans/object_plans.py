"""Queries on the pixel and instance views: matching, suppression, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.scalar import stable
from fieldloom.operators import evaluation as ev
from fieldloom.operators import matching as mt
from fieldloom.operators import neighbourhood as nb
from fieldloom.plans.catalogue import query
from fieldloom.sources.views import INST, PX, instances, pixels

_OVERLAP = f"""WITH {PX},
o AS (SELECT tile, gt, pred, count(*) AS n FROM px WHERE gt IS NOT NULL AND pred IS NOT NULL GROUP BY ALL),
ga AS (SELECT tile, gt, count(*) AS gt_area FROM px WHERE gt IS NOT NULL GROUP BY ALL),
pa AS (SELECT tile, pred, count(*) AS pred_area FROM px WHERE pred IS NOT NULL GROUP BY ALL),
m AS (SELECT o.*, gt_area, pred_area, n / (gt_area + pred_area - n) AS iou FROM o JOIN ga USING (tile, gt) JOIN pa USING (tile, pred)),
best AS (SELECT * FROM m QUALIFY rank() OVER (PARTITION BY tile, gt ORDER BY iou DESC) = 1)"""


def _shown(df):
    return df.select("tile", "gt", "pred", "n", *[stable(c).alias(c) for c in ("iou", "io_ref", "io_pred")])


@query("object_iou_match", _OVERLAP + " SELECT tile, gt, pred, n, round(iou + 1e-9, 6) AS iou, round(n / gt_area + 1e-9, 6) AS io_ref, round(n / pred_area + 1e-9, 6) AS io_pred FROM best")
def object_iou_match(spark, sf_dir):
    return _shown(mt.best_matches(mt.object_overlaps(pixels(spark, sf_dir))))


@query("object_iou_match_touch", f"""WITH {PX},
t AS (SELECT DISTINCT a.tile, a.gt, b.pred FROM px a JOIN px b ON a.tile = b.tile AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 WHERE a.gt IS NOT NULL AND b.pred IS NOT NULL),
o AS (SELECT tile, gt, pred, count(*) AS n FROM px WHERE gt IS NOT NULL AND pred IS NOT NULL GROUP BY ALL),
ga AS (SELECT tile, gt, count(*) AS gt_area FROM px WHERE gt IS NOT NULL GROUP BY ALL),
pa AS (SELECT tile, pred, count(*) AS pred_area FROM px WHERE pred IS NOT NULL GROUP BY ALL),
m AS (SELECT t.tile, t.gt, t.pred, coalesce(n, 0) AS n, gt_area, pred_area, coalesce(n, 0) / (gt_area + pred_area - coalesce(n, 0)) AS iou
  FROM t LEFT JOIN o USING (tile, gt, pred) JOIN ga USING (tile, gt) JOIN pa USING (tile, pred))
SELECT tile, gt, pred, n, round(iou + 1e-9, 6) AS iou, round(n / gt_area + 1e-9, 6) AS io_ref, round(n / pred_area + 1e-9, 6) AS io_pred FROM m
QUALIFY rank() OVER (PARTITION BY tile, gt ORDER BY iou DESC) = 1""")
def object_iou_match_touch(spark, sf_dir):
    return _shown(mt.best_matches(mt.object_overlaps(pixels(spark, sf_dir), touch=True)))


@query("object_centroid_metrics", _OVERLAP + """,
gc AS (SELECT tile, gt, avg(r) AS gr, avg(c) AS gc FROM px GROUP BY ALL), pc AS (SELECT tile, pred, avg(r) AS pr, avg(c) AS pc FROM px GROUP BY ALL)
SELECT tile, gt, pred, round(d + 1e-9, 6) AS centroid_dist, round(1 - d / (2 * sqrt((gt_area + pred_area) / pi())) + 1e-9, 6) AS pos_sim
FROM (SELECT *, sqrt((gr - pr) * (gr - pr) + (gc - pc) * (gc - pc)) AS d FROM best JOIN gc USING (tile, gt) JOIN pc USING (tile, pred))""")
def object_centroid_metrics(spark, sf_dir):
    px = pixels(spark, sf_dir)
    found = mt.with_centroids(mt.best_matches(mt.object_overlaps(px)), px)
    return found.select("tile", "gt", "pred", stable("centroid_dist").alias("centroid_dist"), stable("pos_sim").alias("pos_sim"))


@query("mean_object_metrics", _OVERLAP + " SELECT count(*) AS matches, round(avg(iou) + 1e-9, 6) AS iou, round(avg(n / gt_area) + 1e-9, 6) AS io_ref FROM best")
def mean_object_metrics(spark, sf_dir):
    best = mt.best_matches(mt.object_overlaps(pixels(spark, sf_dir)))
    return best.agg(F.count("*").alias("matches"), stable(F.avg("iou")).alias("iou"), stable(F.avg("io_ref")).alias("io_ref"))


@query("score_area_filter", f"WITH {INST} SELECT inst, tile, score, w * h AS area FROM inst WHERE score > 10 AND w * h > 60")
def score_area_filter(spark, sf_dir):
    return instances(spark, sf_dir).where("score > 10 AND w * h > 60").selectExpr("inst", "tile", "score", "w * h AS area")


@query("nms_antijoin", f"""WITH {INST}, k AS (SELECT *, w * h AS area FROM inst WHERE score > 10)
SELECT inst, tile, x0, y0, w, h, score FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE a.tile = b.tile AND b.score > a.score AND
  greatest(least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0), 0) * greatest(least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0), 0)
  / (a.area + b.area - greatest(least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0), 0) * greatest(least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0), 0)) > 0.05)""")
def nms_antijoin(spark, sf_dir):
    return mt.suppress(instances(spark, sf_dir), 10, 0.05)


@query("overlap_raster", f"""WITH {INST}, k AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY inst) AS k FROM inst),
rr AS (SELECT *, unnest(range(y0, y0 + h)) AS r FROM k), cc AS (SELECT *, unnest(range(x0, x0 + w)) AS c FROM rr)
SELECT tile, r, c, count(*) AS n, CAST(sum(k) AS BIGINT) AS mask_sum FROM cc GROUP BY tile, r, c""")
def overlap_raster(spark, sf_dir):
    return mt.overlap_raster(instances(spark, sf_dir))


@query("box_xyxy_validity", f"WITH {INST} SELECT inst, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM inst WHERE greatest(0, least(x0 + w, 96) - greatest(x0, 0)) * greatest(0, least(y0 + h, 96) - greatest(y0, 0)) > 0 AND w >= 6 AND h >= 6")
def box_xyxy_validity(spark, sf_dir):
    inside = F.expr("greatest(0, least(x0 + w, 96) - greatest(x0, 0)) * greatest(0, least(y0 + h, 96) - greatest(y0, 0)) > 0")
    return instances(spark, sf_dir).where(inside & F.expr("w >= 6 AND h >= 6")).selectExpr("inst", "x0", "y0", "x0 + w AS x1", "y0 + h AS y1")


_COUNTS = """count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn"""
_SCORES = """round((tp + tn) / (tp + fp + fn + tn) + 1e-9, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END + 1e-9, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END + 1e-9, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END + 1e-9, 6) AS f1"""
_METRICS = ("accuracy", "precision", "recall", "f1")


def _rounded(df, *extra):
    return df.select(*[stable(c).alias(c) if c in (*_METRICS, *extra) else F.col(c) for c in df.columns])


@query("pixel_confusion", f"WITH {PX}, b AS (SELECT gt IS NOT NULL AS g, pred IS NOT NULL AS p FROM px), n AS (SELECT {_COUNTS} FROM b) SELECT tp, fp, fn, tn, {_SCORES} FROM n")
def pixel_confusion(spark, sf_dir):
    return _rounded(ev.confusion(pixels(spark, sf_dir), F.col("gt").isNotNull(), F.col("pred").isNotNull(), []))


def _bound(label, name, source):
    own = f"coalesce({label}, -1)"
    moved = [f"coalesce({f}({own}, 1) OVER ({w}) <> {own}, false)" for f in ("lag", "lead") for w in ("PARTITION BY tile, c ORDER BY r", "PARTITION BY tile, r ORDER BY c")]
    return f"{name} AS (SELECT *, {' OR '.join(moved)} AS {name} FROM {source})"


_BOUNDS = f"WITH {PX}, {_bound('gt', 'gb', 'px')}, {_bound('pred', 'pb', 'gb')}"


@query("boundary_mask", _BOUNDS + " SELECT tile, r, c, gb, pb FROM pb")
def boundary_mask(spark, sf_dir):
    px = nb.boundary(nb.boundary(pixels(spark, sf_dir), "gt", "gb"), "pred", "pb")
    return px.select("tile", "r", "c", "gb", "pb")


_DILATED = _BOUNDS + """, d1 AS (SELECT *, max(CAST(gb AS INT)) OVER (PARTITION BY tile, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a,
  max(CAST(pb AS INT)) OVER (PARTITION BY tile, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b FROM pb),
d AS (SELECT *, max(a) OVER (PARTITION BY tile, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 0 AS gd,
  max(b) OVER (PARTITION BY tile, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 0 AS pd FROM d1)"""


def _dilated(spark, sf_dir):
    px = nb.boundary(nb.boundary(pixels(spark, sf_dir), "gt", "gb"), "pred", "pb")
    return nb.dilated(nb.dilated(px, "gb", "gd"), "pb", "pd")


@query("dilate3", _DILATED + " SELECT tile, r, c, gd FROM d")
def dilate3(spark, sf_dir):
    return _dilated(spark, sf_dir).select("tile", "r", "c", "gd")


def _square2(mask, name, source):
    """Dilation by the 2 x 2 square of a pixel, the one above, the one to the left and the one between."""
    return f"""{name}0 AS (SELECT *, greatest(CAST({mask} AS INT), coalesce(lag(CAST({mask} AS INT)) OVER (PARTITION BY tile, c ORDER BY r), 0)) AS {name}i FROM {source}),
{name} AS (SELECT *, greatest({name}i, coalesce(lag({name}i) OVER (PARTITION BY tile, r ORDER BY c), 0)) > 0 AS {name} FROM {name}0)"""


#: The pixels next to or in a field, their boundaries and the boundaries' dilations.
_RASTER = _BOUNDS + f""", fl AS (SELECT DISTINCT a.tile, a.r + dr - 1 AS r, a.c + dc - 1 AS c FROM px a, range(3) x(dr), range(3) y(dc) WHERE a.gt > 0),
{_square2('gb', 'gd', 'pb')}, {_square2('pb', 'pd', 'gd')}, rs AS (SELECT pd.* FROM pd SEMI JOIN fl USING (tile, r, c))"""
_BOUND_COUNTS = _COUNTS.replace("(g ", "(gb ").replace("NOT g", "NOT gb").replace("AND p)", "AND pb)").replace("NOT p)", "NOT pb)")
_ZERO_SCORES = """round((tp + tn) / (tp + fp + fn + tn) + 1e-9, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END + 1e-9, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END + 1e-9, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END + 1e-9, 6) AS f1"""


def _bound_counts(spark, sf_dir):
    return ev.confusion(ev.rastered(pixels(spark, sf_dir)), F.col("gb"), F.col("pb"), ["tile"])


@query("boundary_f1", _RASTER + f", n AS (SELECT tile, {_BOUND_COUNTS} FROM rs GROUP BY tile) SELECT tile, tp, fp, fn, tn, {_ZERO_SCORES} FROM n")
def boundary_f1(spark, sf_dir):
    """Boundary scores in and next to the fields; a score of nothing is 0."""
    return _rounded(_bound_counts(spark, sf_dir).fillna(0.0, ["precision", "recall", "f1"]))


@query("boundary_f1_tolerant", _RASTER + """, n AS (SELECT tile, coalesce(count(*) FILTER (pb AND gd) / nullif(count(*) FILTER (pb), 0), 0) AS p, coalesce(count(*) FILTER (gb AND pd) / nullif(count(*) FILTER (gb), 0), 0) AS q FROM rs GROUP BY tile)
SELECT tile, round(2 * p * q / nullif(p + q, 0) + 1e-9, 6) AS f1_b FROM n""")
def boundary_f1_tolerant(spark, sf_dir):
    return ev.tolerant_f1(ev.rastered(pixels(spark, sf_dir))).withColumn("f1_b", stable("f1_b"))


@query("boundary_f1_weighted", _RASTER + f""", n AS (SELECT tile, {_BOUND_COUNTS} FROM rs GROUP BY tile),
w AS (SELECT *, (fp + tn) / (tp + fp + fn + tn) AS wp, (tp + fn) / (tp + fp + fn + tn) AS wn FROM n)
SELECT tile, round((CASE WHEN 2 * wp * tp + wn * fp + wp * fn <> 0 THEN 2 * wp * tp / (2 * wp * tp + wn * fp + wp * fn) END
  + CASE WHEN 2 * wn * tn + wn * fp + wp * fn <> 0 THEN 2 * wn * tn / (2 * wn * tn + wn * fp + wp * fn) END) / 2 + 1e-9, 6) AS f1_w FROM w""")
def boundary_f1_weighted(spark, sf_dir):
    return ev.balanced_f1(_bound_counts(spark, sf_dir)).select("tile", stable("f1_w").alias("f1_w"))


_CELLS = _RASTER + ", x AS (SELECT tile, coalesce(gt, -1) AS g, coalesce(pred, -1) AS p, count(*) AS n FROM rs GROUP BY ALL)"


@query("adjusted_rand", _CELLS + """, a AS (SELECT tile, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM x GROUP BY tile),
g AS (SELECT tile, sum(m * (m - 1) / 2) AS sg FROM (SELECT tile, g, sum(n) AS m FROM x GROUP BY ALL) GROUP BY tile),
p AS (SELECT tile, sum(m * (m - 1) / 2) AS sp FROM (SELECT tile, p, sum(n) AS m FROM x GROUP BY ALL) GROUP BY tile)
SELECT tile, round(CASE WHEN (sg + sp) / 2 = sg * sp / (t * (t - 1) / 2) THEN 1.0 ELSE (s - sg * sp / (t * (t - 1) / 2)) / ((sg + sp) / 2 - sg * sp / (t * (t - 1) / 2)) END + 1e-9, 6) AS rand
FROM a JOIN g USING (tile) JOIN p USING (tile)""")
def adjusted_rand(spark, sf_dir):
    return ev.adjusted_rand(ev.rastered(pixels(spark, sf_dir))).select("tile", stable("rand").alias("rand"))


@query("v_measure", _CELLS + """, a AS (SELECT tile, sum(n * ln(n)) AS s, sum(n) AS t FROM x GROUP BY tile),
g AS (SELECT tile, sum(m * ln(m)) AS sg FROM (SELECT tile, g, sum(n) AS m FROM x GROUP BY ALL) GROUP BY tile),
p AS (SELECT tile, sum(m * ln(m)) AS sp FROM (SELECT tile, p, sum(n) AS m FROM x GROUP BY ALL) GROUP BY tile),
h AS (SELECT tile, ln(t) - sg / t AS hg, ln(t) - sp / t AS hp, ln(t) - s / t AS hh FROM a JOIN g USING (tile) JOIN p USING (tile)),
v AS (SELECT tile, CASE WHEN hg > 1e-12 THEN (hg + hp - hh) / hg ELSE 1.0 END AS ho, CASE WHEN hp > 1e-12 THEN (hg + hp - hh) / hp ELSE 1.0 END AS co FROM h)
SELECT tile, round(CASE WHEN ho + co > 0 THEN 2 * ho * co / (ho + co) ELSE 0.0 END + 1e-9, 6) AS v_measure FROM v""")
def v_measure(spark, sf_dir):
    return ev.v_measure(ev.rastered(pixels(spark, sf_dir))).select("tile", stable("v_measure").alias("v_measure"))


@query("coco_gt_annotations", f"WITH {PX} SELECT tile, gt AS label, count(*) AS area, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h, count(*) / 65536 AS score FROM px WHERE gt IS NOT NULL GROUP BY tile, gt")
def coco_gt_annotations(spark, sf_dir):
    return ev.annotations(pixels(spark, sf_dir), "gt", 65536)


@query("coco_pred_annotations", f"WITH {PX} SELECT tile, pred AS label, count(*) AS area, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h, count(*) / 65536 AS score FROM px WHERE pred IS NOT NULL GROUP BY tile, pred")
def coco_pred_annotations(spark, sf_dir):
    return ev.annotations(pixels(spark, sf_dir), "pred", 65536)


@query("rle_runs", f"""WITH {PX}, a AS (SELECT tile, gt AS label, c * 16 + r AS place FROM px WHERE gt IS NOT NULL),
i AS (SELECT *, place - row_number() OVER (PARTITION BY tile, label ORDER BY place) AS island FROM a)
SELECT tile, label, min(place) AS start, count(*) AS length FROM i GROUP BY tile, label, island""")
def rle_runs(spark, sf_dir):
    return ev.rle_runs(pixels(spark, sf_dir), "gt", 16)


_CLASSES = {"all": (0, 65536), "s": (0, 12), "m": (12, 14), "l": (14, 65536)}
_CURVES = _OVERLAP + """, st AS (SELECT CAST(round(0.5 + 0.05 * k, 2) AS DOUBLE) AS iou_thr FROM range(10) s(k)),
sz AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in _CLASSES.items()) + """) v(size, low, high)),
ca AS (SELECT iou_thr, size, low, high, m.tile, m.gt, m.pred, m.iou, pred_area AS score, gt_area FROM m, st, sz WHERE iou >= iou_thr),
hi AS (SELECT *, row_number() OVER (PARTITION BY size, iou_thr, tile, gt ORDER BY score DESC, pred) AS a, row_number() OVER (PARTITION BY size, iou_thr, tile, pred ORDER BY iou DESC, gt) AS b FROM ca),
al AS (SELECT size, iou_thr, pa.pred_area AS score, h.pred IS NOT NULL AS hit FROM pa CROSS JOIN st CROSS JOIN sz LEFT JOIN (SELECT * FROM hi WHERE a = 1 AND b = 1) h USING (size, iou_thr, tile, pred)
  WHERE CASE WHEN h.pred IS NOT NULL THEN h.gt_area BETWEEN sz.low AND sz.high ELSE pa.pred_area BETWEEN sz.low AND sz.high END),
sc AS (SELECT size, iou_thr, score, count(*) AS n, count(*) FILTER (hit) AS hits FROM al GROUP BY ALL),
ob AS (SELECT size, count(*) AS objects FROM ga, sz WHERE gt_area BETWEEN low AND high GROUP BY size),
cu AS (SELECT size, iou_thr, score, objects, sum(n) OVER w AS seen, sum(hits) OVER w AS tp FROM sc JOIN ob USING (size) WINDOW w AS (PARTITION BY size, iou_thr ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tp / objects AS recall, tp / seen AS precision FROM cu),
be AS (SELECT *, max(precision) OVER (PARTITION BY size, iou_thr ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM pr),
re AS (SELECT size, iou_thr, k, max(best) AS p FROM be, range(101) l(k) WHERE recall >= k / 100 - 1e-12 GROUP BY ALL),
ap AS (SELECT size, iou_thr, sum(p) / 101 AS ap FROM re GROUP BY ALL), tr AS (SELECT size, iou_thr, max(recall) AS recall FROM pr GROUP BY ALL),
al2 AS (SELECT size, iou_thr, CASE WHEN objects IS NULL THEN -1.0 ELSE coalesce(ap, 0) END AS ap, CASE WHEN objects IS NULL THEN -1.0 ELSE coalesce(recall, 0) END AS recall
  FROM sz CROSS JOIN st LEFT JOIN ob USING (size) LEFT JOIN tr USING (size, iou_thr) LEFT JOIN ap USING (size, iou_thr))"""


def _curves(spark, sf_dir):
    """Curves of all size classes; a detection's score is its area, as in the annotations."""
    truths, found = ev.matched_detections(pixels(spark, sf_dir))
    return ev.precision_curves(truths, found.withColumn("score", F.col("area")), _CLASSES)


@query("coco_ap", _CURVES + " SELECT iou_thr, round(ap + 1e-9, 6) AS ap, round(recall + 1e-9, 6) AS recall FROM al2 WHERE size = 'all'")
def coco_ap(spark, sf_dir):
    """Average precision and recall at ten thresholds over all sizes."""
    return _curves(spark, sf_dir).where("size = 'all'").select("iou_thr", stable("ap").alias("ap"), stable("recall").alias("recall"))


_MEAN = lambda c, k, extra="": f"coalesce(round(avg({c}) FILTER (size = '{k}' AND {c} > -1{extra}) + 1e-9, 6), -1.0)"


@query("coco_summary", _CURVES + f""" SELECT {_MEAN('ap', 'all')} AS "AP_IoU_0_50:0_95", {_MEAN('ap', 'all', ' AND iou_thr = 0.5')} AS "AP_IoU_0_50", {_MEAN('ap', 'all', ' AND iou_thr = 0.75')} AS "AP_IoU_0_75",
{_MEAN('ap', 's')} AS "AP_IoU_s", {_MEAN('ap', 'm')} AS "AP_IoU_m", {_MEAN('ap', 'l')} AS "AP_IoU_l", {_MEAN('recall', 'all')} AS "AR_max", {_MEAN('recall', 's')} AS "AR_max_s", {_MEAN('recall', 'm')} AS "AR_max_m", {_MEAN('recall', 'l')} AS "AR_max_l" FROM al2""")
def coco_summary(spark, sf_dir):
    found = ev.coco_summary(_curves(spark, sf_dir))
    named = {c: F.col(f"`{c}`") for c in found.columns}
    return found.select(*[F.when(v < 0, -1.0).otherwise(stable(v)).alias(c.replace(".", "_")) for c, v in named.items()])
