"""Raster metrics, instance evaluation, shapes and post-processing against loops over pixels."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import evaluation as ev
from fieldloom.operators import kernels as k
from fieldloom.operators import postprocess as pp
from fieldloom.operators import relational as rel
from fieldloom.operators import shapes as sh

GT = [[0, 0, 0, 0, 0, 0], [0, 1, 1, 0, 0, 0], [0, 1, 1, 0, 0, 0], [0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0]]
PRED = [[0, 0, 0, 0, 0, 0], [0, 0, 2, 2, 0, 0], [0, 0, 2, 2, 0, 0], [0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 5], [0, 0, 0, 0, 5, 5]]


def frame(spark, gt, pred):
    rows = [(0, r, c, int(g) or None, int(p) or None) for r, (gs, ps) in enumerate(zip(gt, pred)) for c, (g, p) in enumerate(zip(gs, ps))]
    return spark.createDataFrame(rows, "tile long, r long, c long, gt long, pred long")


def around(a, r, c, steps):
    return [a[r + i][c + j] for i, j in steps if 0 <= r + i < len(a) and 0 <= c + j < len(a[0])]


def boundaries(a):
    return [[any(x != v for x in around(a, r, c, [(0, 1), (1, 0), (0, -1), (-1, 0)])) for c, v in enumerate(row)] for r, row in enumerate(a)]


def spread(a, steps):
    return [[any(around(a, r, c, steps)) for c in range(len(a[0]))] for r in range(len(a))]


def loops(gt, pred):
    """Everything inside the 3 x 3 dilation of the fields, pixel by pixel."""
    inside = spread([[v > 0 for v in row] for row in gt], [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    gb, pb = boundaries(gt), boundaries(pred)
    two = [(0, 0), (-1, 0), (0, -1), (-1, -1)]
    gd, pd_ = spread(gb, two), spread(pb, two)
    at = [(r, c) for r in range(len(gt)) for c in range(len(gt[0])) if inside[r][c]]
    flat = lambda a: np.array([a[r][c] for r, c in at])
    return flat(gb), flat(pb), flat(gd), flat(pd_), flat(gt), flat(pred)


def test_boundary_scores_by_hand(spark):
    """A 2 x 2 field and a prediction moved right by one: 16 pixels count, the far prediction does not."""
    px = ev.rastered(frame(spark, GT, PRED))
    assert px.count() == 16
    got = ev.confusion(px, F.col("gb"), F.col("pb"), []).first()
    # the true boundary is the field and the pixels beside it (12); of the predicted one, 10 of 12 pixels are inside
    assert (got.tp + got.fn, got.tp + got.fp) == (12, 10)


@pytest.mark.parametrize("seed", range(3))
def test_raster_metrics_match_loops(spark, seed):
    rng = random.Random(seed)
    gt, pred = ([[rng.choice([0, 0, 1, 2, 3]) if (r // 2 + c // 2) % 2 else 0 for c in range(9)] for r in range(7)] for _ in range(2))
    gb, pb, gd, pd_, g, p = loops(gt, pred)
    px = ev.rastered(frame(spark, gt, pred))
    got = ev.confusion(px, F.col("gb"), F.col("pb"), []).first()
    assert (got.tp, got.fp, got.fn, got.tn) == ((gb & pb).sum(), (~gb & pb).sum(), (gb & ~pb).sum(), (~gb & ~pb).sum())
    a, b = (pb & gd).sum() / max(1, pb.sum()), (gb & pd_).sum() / max(1, gb.sum())
    assert ev.tolerant_f1(px).first().f1_b == pytest.approx(2 * a * b / (a + b))
    n = len(g)
    same = lambda x: sum(math.comb(int(m), 2) for m in pd.Series(x).value_counts())
    both, expected = same(g * 10 + p), same(g) * same(p) / math.comb(n, 2)
    assert ev.adjusted_rand(px).first().rand == pytest.approx((both - expected) / ((same(g) + same(p)) / 2 - expected))


def test_even_dilation_reaches_down_and_right(spark):
    from fieldloom.operators.neighbourhood import dilated

    px = frame(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]], [[0] * 3] * 3).withColumn("m", F.col("gt").isNotNull())
    assert sorted((r.r, r.c) for r in dilated(px, "m", "d", 2).where("d").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def greedy(truths, found, low, high, thr):
    """Published greedy matching of one image set; found is (tile, score, area, {gt: iou}), truths (tile, gt) -> area."""
    npos = sum(low <= a <= high for a in truths.values())
    taken, marks = set(), []
    for tile, score, area, ious in sorted(found, key=lambda d: -d[1]):
        free = [(not low <= truths[tile, g] <= high, -i, g) for g, i in ious.items() if i >= thr and (tile, g) not in taken]
        if free:
            ignored, _, g = min(free)
            taken.add((tile, g))
            if not ignored:
                marks.append((score, 1))
        elif low <= area <= high:
            marks.append((score, 0))
    if not npos:
        return -1, -1
    points, tp, seen = [], 0, 0
    for at, (score, hit) in enumerate(marks):
        tp, seen = tp + hit, seen + 1
        if at + 1 == len(marks) or marks[at + 1][0] != score:
            points.append((tp / npos, tp / seen))
    ap = np.mean([max((p for r, p in points if r >= t / 100 - 1e-12), default=0) for t in range(101)])
    return ap, max((r for r, _ in points), default=0)


def test_precision_by_size_matches_greedy_matching(spark):
    rng = random.Random(3)
    rows, truths, found = [], {}, []
    for tile in range(12):
        gt = [[(r // 3) * 4 + c // 3 + 1 if rng.random() < 0.9 else 0 for c in range(12)] for r in range(9)]
        pred = [[((r + tile % 2) // 3) * 4 + c // 3 + 1 if rng.random() < 0.85 else 0 for c in range(12)] for r in range(9)]
        rows += [(tile, r, c, gt[r][c] or None, pred[r][c] or None) for r in range(9) for c in range(12)]
        g, p = np.array(gt), np.array(pred)
        truths |= {(tile, int(x)): int((g == x).sum()) for x in np.unique(g[g > 0])}
        for x in np.unique(p[p > 0]):
            ious = {int(y): ((g == y) & (p == x)).sum() / ((g == y) | (p == x)).sum() for y in np.unique(g[(p == x) & (g > 0)])}
            found.append((tile, int((p == x).sum()), int((p == x).sum()), ious))
    sizes = {"all": (0, 65536), "s": (0, 7), "m": (7, 8), "l": (9, 65536), "none": (100, 200)}
    px = spark.createDataFrame(rows, "tile long, r long, c long, gt long, pred long")
    t, f = ev.matched_detections(px)
    got = {(r.size, r.iou_thr): (r.ap, r.recall) for r in ev.precision_curves(t, f.withColumn("score", F.col("area")), sizes, (0.55, 0.75)).collect()}
    for name, (low, high) in sizes.items():
        for thr in (0.55, 0.75):
            assert got[name, thr] == pytest.approx(greedy(truths, found, low, high, thr)), (name, thr)


def test_shapes_match_kernels(spark):
    rng = random.Random(7)
    grid = np.array([[rng.choice([0, 1, 1, 2]) for _ in range(11)] for _ in range(9)])
    rows = [(0, r, c, int(grid[r, c]) or None) for r in range(9) for c in range(11)]
    px = sh.labelled(spark.createDataFrame(rows, "tile long, r long, c long, gt long"), "gt")
    hu, axes, euler = ({r.label: r for r in f(px).collect()} for f in (sh.hu_moments, sh.axes, sh.euler_numbers))
    for label in (1, 2):
        mask = grid == label
        assert [hu[label][f"hu_{n}"] for n in range(1, 8)] == pytest.approx(k.hu_moments(mask), abs=1e-9)
        assert (axes[label].axis_major, axes[label].axis_minor, axes[label].eccentricity) == pytest.approx(k.axis_lengths(mask))
        assert (euler[label].euler_4, euler[label].euler_8) == (k.euler_number(mask, False), k.euler_number(mask, True))


def test_perimeters_by_hand(spark):
    """A pixel has none, a 3 x 3 square has 8 rim pixels in a ring, a diagonal pair one step."""
    rows = [(0, 1, 0, 0)] + [(0, 2, r, c) for r in range(3, 6) for c in range(3, 6)]
    got = {r.label: r.perimeter for r in sh.perimeters(spark.createDataFrame(rows, "tile long, label long, r long, c long")).collect()}
    assert got == {1: 0, 2: 8}


def test_merged_masks_by_hand():
    a, b = np.zeros((4, 8), bool), np.zeros((4, 8), bool)
    a[:2, :3] = a[3, 7] = True  # the lone pixel goes
    b[1:3, 2:5] = True
    labels = pp.merged_labels([a, b], 2)
    # sums 1, 3 and 2: the overlap is one pixel and goes as too small
    assert sorted(np.unique(labels[labels > 0], return_counts=True)[1].tolist()) == [5, 5] and labels[1, 2] == labels[3, 7] == 0
    assert (pp.label_values(np.array([[1, 0, 1], [0, 1, 0], [2, 0, 1]])) == [[1, 0, 1], [0, 1, 0], [2, 0, 1]]).all()


def test_labels_match_flood_fill():
    rng = np.random.default_rng(4)
    for diagonal in (True, False):
        for _ in range(30):
            values = rng.integers(0, 3, (7, 9))
            got = pp.label_values(values, diagonal)
            seen, want = np.zeros(values.shape, int), 0
            for r, c in np.ndindex(values.shape):
                if values[r, c] and not seen[r, c]:
                    want, stack = want + 1, [(r, c)]
                    while stack:
                        y, x = stack.pop()
                        if 0 <= y < 7 and 0 <= x < 9 and not seen[y, x] and values[y, x] == values[r, c]:
                            seen[y, x] = want
                            stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (diagonal or not (i and j))]
            assert (got == seen).all()


def test_group_folds_are_balanced_and_whole(spark):
    rows = [(g, i) for g in range(20) for i in range(1 + g * 3)]
    df = spark.createDataFrame(rows, "g long, i long")
    folds = rel.balanced_group_folds(df.groupBy("g").agg(F.count("*").alias("n")), "g", "n", 4, 3)
    table = rel.train_test_rows(df, folds, "g", 4)
    tests = table.where("is_test").groupBy("repeat", "fold").count().collect()
    assert len(tests) == 12 and max(t["count"] for t in tests) - min(t["count"] for t in tests) <= 12
    assert table.groupBy("repeat", "g").agg(F.countDistinct(F.when(F.col("is_test"), F.col("fold"))).alias("k")).where("k <> 1").count() == 0
    assert len({tuple(sorted((r.g, r.fold) for r in folds.where(f"repeat = {k}").collect())) for k in range(3)}) > 1


def test_meta_columns_come_first(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, m int, b int, n int")
    assert rel.meta_first(df, ["m", "n"]).columns == ["n", "m", "a", "b"]


def test_mask_suppression_broadcasts_nothing(spark):
    rng = np.random.default_rng(5)
    boxes = [(t, i, float(s), *rng.integers(0, 20, 2)) for t in range(3) for i, s in enumerate(rng.permutation(8))]
    rows = [(t, i, s, int(y + r), int(x + c)) for t, i, s, y, x in boxes for r in range(6) for c in range(6)]
    px = spark.createDataFrame(rows, "tile bigint, inst bigint, score double, r bigint, c bigint")
    overlaps, left = pp.mask_overlaps(px, 1.0, 25), pp.suppressed_masks(px, 1.0, 25, 0.1).select("tile", "inst", "score", "r", "c")
    found, got = {(r.tile, r.a, r.b): r.iou for r in overlaps.collect()}, {tuple(r) for r in left.collect()}
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in (overlaps, left))
    of = {(t, i): (s, {(r, c) for t2, i2, _, r, c in rows if (t2, i2) == (t, i)}) for t, i, s, *_ in boxes if s > 1}
    iou = {(*a, b[1]): len(of[a][1] & of[b][1]) / len(of[a][1] | of[b][1]) for a in of for b in of if a[0] == b[0] and of[a][0] > of[b][0] and of[a][1] & of[b][1]}
    assert found == pytest.approx(iou)
    beaten = {(t, b) for (t, _, b), x in iou.items() if x > 0.1}
    assert beaten and got == {r for r in rows if r[:2] in of and r[:2] not in beaten}
