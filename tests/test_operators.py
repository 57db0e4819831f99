import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalar as sc
from fieldloom.operators import curation as cu
from fieldloom.operators import evaluation as ev
from fieldloom.operators import matching as mt
from fieldloom.operators import models
from fieldloom.operators import neighbourhood as nb


def raster(spark, gt, pred=None, value=None, tile=0):
    gt = np.array(gt)
    pred = gt if pred is None else np.array(pred)
    value = np.zeros(gt.shape) if value is None else np.array(value, float)
    label = lambda x: int(x) if x > 0 else None
    rows = [(tile, r, c, float(value[r, c]), label(gt[r, c]), label(pred[r, c])) for r in range(gt.shape[0]) for c in range(gt.shape[1])]
    return spark.createDataFrame(rows, "tile bigint, r bigint, c bigint, value double, gt bigint, pred bigint")


GT = [[1, 1, 0, 2], [1, 1, 0, 2], [0, 0, 0, 0], [3, 3, 0, 0]]
PRED = [[1, 1, 0, 0], [0, 0, 2, 0], [0, 0, 2, 0], [0, 0, 0, 0]]


def test_matching_drops_the_unmatched_and_keeps_ties(spark):
    found = {(r.gt, r.pred): r.iou for r in mt.best_matches(mt.object_overlaps(raster(spark, GT, PRED), touch=True)).collect()}
    assert found[1, 1] == pytest.approx(0.5)
    assert found[2, 2] == 0 and found[3, 2] == 0  # they only touch
    assert set(found) == {(1, 1), (2, 2), (3, 2)}
    plain = {(r.gt, r.pred) for r in mt.best_matches(mt.object_overlaps(raster(spark, GT, PRED))).collect()}
    assert plain == {(1, 1)}
    tie = mt.best_matches(mt.object_overlaps(raster(spark, [[1, 1, 1, 1]], [[1, 1, 2, 2]])))
    assert sorted(r.pred for r in tie.collect()) == [1, 2]


def test_suppression_is_not_greedy(spark):
    boxes = [(1, 0, 0, 0, 10, 10, 9.0), (2, 0, 5, 0, 10, 10, 8.0), (3, 0, 10, 0, 10, 10, 7.0), (4, 1, 0, 0, 10, 10, 1.0), (5, 1, 0, 0, 10, 10, 1.0)]
    df = spark.createDataFrame(boxes, "inst int, tile int, x0 int, y0 int, w int, h int, score double")
    assert sorted(r.inst for r in mt.suppress(df, 0, 0.2).collect()) == [1, 4, 5]


def test_overlap_raster_may_collide(spark):
    boxes = [(1, 0, 0, 0, 2, 1, 1.0), (2, 0, 1, 0, 2, 1, 1.0), (3, 0, 5, 0, 1, 1, 1.0)]
    df = spark.createDataFrame(boxes, "inst int, tile int, x0 int, y0 int, w int, h int, score double")
    assert {(r.c, r.n, r.mask_sum) for r in mt.overlap_raster(df).collect()} == {(0, 1, 1), (1, 2, 3), (2, 1, 2), (5, 1, 3)}


def test_boundary_of_two_labels_and_of_one(spark):
    got = nb.boundary(raster(spark, [[1, 1, 2, 2]] * 4), "gt", "edge").where("edge").select("c").distinct().collect()
    assert sorted(r.c for r in got) == [1, 2]
    assert nb.boundary(raster(spark, [[1] * 4] * 4), "gt", "edge").where("edge").count() == 0
    dilated = nb.dilated(nb.boundary(raster(spark, [[1, 1, 1, 1, 2]] * 3), "gt", "edge"), "edge", "wide")
    assert sorted({r.c for r in dilated.where("wide").collect()}) == [2, 3, 4]


@pytest.mark.parametrize("size", [3, 5])
def test_moving_std_reflects_edges(spark, size):
    value = np.random.default_rng(0).random((6, 6)) * 9
    k = size // 2
    padded = np.pad(value, k, mode="reflect")
    got = {(r.r, r.c): r["std"] for r in nb.moving_std(raster(spark, [[1] * 6] * 6, value=value), ["value"], size, 5, ["std"]).collect()}
    for (r, c), s in got.items():
        assert s == pytest.approx(padded[r : r + size, c : c + size].std(), abs=1e-6)
    assert len(got) == 36


def test_small_objects_and_entropy(spark):
    big = [[1] * 5 for _ in range(5)] + [[2] * 4 + [3] for _ in range(6)]
    left = nb.without_small(raster(spark, big), "gt", 25).where("gt IS NOT NULL").select("gt").distinct().collect()
    assert [r.gt for r in left] == [1]
    left = nb.without_small(raster(spark, big), "gt", 24).where("gt IS NOT NULL").select("gt").distinct().collect()
    assert sorted(r.gt for r in left) == [1, 2]
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, -1.0), (3, 5.0)], "g int, x double")
    got = {r.g: r.entropy for r in nb.entropy(df, ["g"], F.col("x")).collect()}
    assert got == {1: pytest.approx(0), 2: pytest.approx(np.log(2))}


def test_clustering_metrics(spark):
    same = raster(spark, GT)
    assert ev.adjusted_rand(same).first().rand == 1 and ev.v_measure(same).first().v_measure == pytest.approx(1)
    mixed = raster(spark, [[1, 1, 2, 2]], [[1, 2, 1, 2]])
    assert ev.adjusted_rand(mixed).first().rand == pytest.approx(-0.5) and ev.v_measure(mixed).first().v_measure == pytest.approx(0, abs=1e-9)
    renamed = raster(spark, GT, np.array([0, 7, 5, 9])[np.array(GT)])
    assert ev.adjusted_rand(renamed).first().rand == 1


def test_average_precision(spark):
    thresholds = [0.5, 0.75]

    def ap(gt, pred):
        truths, found = ev.matched_detections(raster(spark, gt, pred))
        curves = ev.precision_curves(truths, found.withColumn("score", F.col("area")), {"all": (0, 65536)}, tuple(thresholds))
        return {r.iou_thr: (r.ap, r.recall) for r in curves.collect()}

    assert ap(GT, GT) == {0.5: (pytest.approx(1), 1), 0.75: (pytest.approx(1), 1)}
    assert ap(GT, np.zeros((4, 4))) == {0.5: (0, 0), 0.75: (0, 0)}
    assert ap(np.zeros((4, 4)), GT) == {0.5: (-1, -1), 0.75: (-1, -1)}
    half = ap([[1, 1, 1, 1]], [[1, 1, 0, 0]])
    assert half[0.5] == (pytest.approx(1), 1) and half[0.75] == (0, 0)


def test_confusion_and_balanced_f1(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "y boolean, p boolean")
    r = ev.balanced_f1(ev.confusion(df, F.col("y"), F.col("p"), [])).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 2) and r.f1 == pytest.approx(2 / 3)
    assert r.f1_w == pytest.approx((2 / 3 + 0.8) / 2)
    nothing = ev.confusion(df.where("NOT y AND NOT p"), F.col("y"), F.col("p"), []).first()
    assert nothing.f1 is None and nothing.accuracy == 1


def test_rle_and_annotations(spark):
    px = raster(spark, GT)
    assert sorted((r.label, r.start, r.length) for r in ev.rle_runs(px, "gt", 4).collect()) == [(1, 0, 2), (1, 4, 2), (2, 12, 2), (3, 3, 1), (3, 7, 1)]
    box = {r.label: (r.x, r.y, r.w, r.h, r.area) for r in ev.annotations(px, "gt", 16).collect()}
    assert box == {1: (0, 0, 2, 2, 4), 2: (3, 0, 1, 2, 2), 3: (0, 3, 2, 1, 2)}


def test_curation(spark):
    f = spark.createDataFrame([(1, 1, 50.0, None, None, 10.0), (1, 2, 70.0, 1, None, None), (2, 3, 90.0, 2, 3, 45.0)], "tile_id int, field_id int, area double, cls_0 int, cls_1 int, agri double")
    assert [r.field_id for r in cu.quality_filter(f, 60, ["cls_0", "cls_1"], 2).collect()] == [2]
    got = {r.tile_id: r.agri_share for r in cu.tile_thresholds(f, 0.0, 1).collect()}
    assert got == {1: pytest.approx(10 / 120), 2: 0.5}
    v = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("a", None), ("b", 9)], "g string, v int")
    assert {r.g: r["mode"] for r in cu.mode_smallest(v, ["g"], "v").collect()} == {"a": 1, "b": 9}
    table = {r.g: (r.n_1, r.n_9) for r in cu.crosstab(v, ["g"], F.col("v"), [1, 9]).collect()}
    assert table == {"a": (2, None), "b": (None, 1)}
    assert cu.scaled(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"], "minmax").first().x is None


def test_scalars(spark):
    row = spark.sql("SELECT array(1.0, 3.0, 3.0) AS a, array(2.0, 2.0) AS k").select(sc.argmax(F.col("a")).alias("m"), sc.argmin(F.col("k")).alias("n")).first()
    assert (row.m, row.n) == (1, 0)
    d = spark.sql("SELECT array(1.0D, 2.0D, 4.0D, 7.0D, 11.0D, 16.0D) AS x").select(sc.lag_differences(F.col("x")).alias("d")).first().d
    assert d == [3, 5, 7, 9]


def test_group_folds_keep_groups_whole(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 13)
    got = cu.group_folds(df, "g", 5, 2)
    assert got.groupBy("repeat", "g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_forest_and_search(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.random(4)]) for i in range(400)]
    df = spark.createDataFrame([(i, x, int(x[0] > 0.5)) for i, x in rows], "id int, features array<double>, y int")
    model = models.train_forest(df.where("id % 5 <> 0"), "features", "y", trees=10, subset="all")
    test = models.predict(model, df.where("id % 5 = 0"), "features")
    assert test.where("prediction = y").count() / test.count() > 0.9
    point, value, values = models.minimise(lambda p: (p[0] - 2) ** 2 + (p[1] + 1) ** 2, [(-5, 5), (-5, 5)], calls=30)
    assert value < 0.3 and len(values) == 30
