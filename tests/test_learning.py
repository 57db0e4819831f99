"""Feature sets, subsets and searches against brute force and on worked examples."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fieldloom.operators import evaluation as ev
from fieldloom.operators import features as ft
from fieldloom.operators import models, search
from fieldloom.operators import subsetting as sub


def cube_frame(spark, size=12, tiles=2, seed=0):
    """Tiles of two halves that differ in all bands; the left half is the field."""
    rng = np.random.default_rng(seed)
    rows = []
    for t, r, c in itertools.product(range(tiles), range(size), range(size)):
        left = c < size // 2
        bands = [(0.1 + 0.6 * left + 0.02 * rng.random(6)).tolist() for _ in range(5)]
        rows.append((t, r, c, 1 if left else None, 1 + (not left), int(left), *bands))
    return spark.createDataFrame(rows, "tile long, r long, c long, gt long, label long, is_field int, blue array<double>, green array<double>, red array<double>, nir array<double>, ndvi array<double>")


def test_feature_sets_have_their_sizes(spark):
    px = cube_frame(spark)
    for n, columns in ((1, 20), (2, 28 - 1), (3, 38 - 1), (4, 65 - 1)):  # area is always there
        found = ft.object_features(px, ft.FEATURE_SETS[:n])
        assert len(set(found.columns) - {"uid", "tile", "segment_id", "gt_label", "area"}) == columns
    rows = {r.uid: r for r in found.collect()}
    assert len(rows) == 4 and rows["0_1"].gt_label and not rows["0_2"].gt_label and rows["1_1"].area == 72
    assert rows["0_1"].neighbours_0 == 1 and rows["0_1"].neighbours_6 == 72
    assert len(set(ft.pixel_features(px, 11).columns) - {"uid", "tile", "r", "c", "segment_id", "gt_label"}) == 30
    for wrong in ((), ("geom",), ("spec", "text")):
        with pytest.raises(ValueError):
            ft.object_features(px, wrong)


def test_windows_of_a_partial_tile(spark):
    from fieldloom.operators.neighbourhood import moving_std

    rng = np.random.default_rng(2)
    cells = {(r, c): rng.random() for r in range(5) for c in range(6) if r < 4 or c < 3}
    got = moving_std(spark.createDataFrame([(0, r, c, v) for (r, c), v in cells.items()], "tile long, r long, c long, v double"), ["v"], 3, 5, ["s"])
    inner = lambda x: -x if x < 0 else 10 - x if x > 5 else x
    for row in got.collect():
        near = [cells[p] for i in (-1, 0, 1) for j in (-1, 0, 1) if (p := (inner(row.r + i), inner(row.c + j))) in cells]
        assert row.s == pytest.approx(np.std(near))
    assert got.count() == len(cells)


def test_nearest_and_divergence(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.random((40, 3)), rng.random((25, 3))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    monkeypatch.setattr(sub, "CELLS", 100)
    assert np.allclose(sub.nearest(x, y), d.min(axis=1)) and np.allclose(sub.nearest(x, y, 3), np.sort(d, axis=1)[:, 2])
    own = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 1]
    assert sub.divergence(x, y) == pytest.approx(-np.log(own / d.min(axis=1)).sum() * 3 / 40 + np.log(25 / 39))


def test_elimination_by_hand():
    """The second set shares most with the others and goes first."""
    sets = [np.array(s) for s in ([0, 1, 2], [1, 2, 3], [3, 4, 5], [6, 7, 8])]
    left, overlap = sub.eliminated(sets, 3, 9)
    assert left == [0, 2, 3] and overlap.sum() == 0
    assert sub.eliminated(sets, 4, 9)[1].tolist() == [[0, 2, 0, 0], [2, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]]


def test_chosen_subsets(spark):
    rng = np.random.default_rng(3)
    tiles = pd.DataFrame({"tile": [f"t{k}" for k in range(60)], "a": rng.random(60), "b": rng.random(60)})
    run = lambda: sorted(sub.choose_subsets(spark, tiles, ["a", "b"], [8, 20, 500], subsets=3, trials=200).collect())
    got = run()
    assert [(r.n_samples, r.subset_idx) for r in got] == [(8, 0), (8, 1), (8, 2), (20, 0), (20, 1), (20, 2)] or len(got) == 6
    for r in got:
        assert len(set(r.tile_list)) == r.n_samples and r.tile_list == [f"t{k}" for k in sub.drawn(60, r.n_samples, r.seed, 2)[0]]
    all_ = sub.trial_divergences(spark, tiles[["a", "b"]].to_numpy(), [8], 200).toPandas()
    best = set(all_.sort_values(["kl", "seed"]).seed.head(6))
    assert {r.seed for r in got if r.n_samples == 8} <= best and got == run()


def test_search_settings(spark):
    px = cube_frame(spark)
    cubes = search.cube_of(px.where("tile = 0").toPandas())
    assert cubes.shape == (5, 6, 12, 12)
    for contrast in (None, "FHH", "CLAHE"):
        assert search.enhanced(cubes, contrast).shape == cubes.shape
    labels = search.segment_tile(cubes, {"height": 0.05, "least": 6})
    assert labels[5, 2] != labels[5, 9]
    good, bad = (search.objective(px, {"height": h, "least": 6}) for h in (0.05, 1e6))
    assert -1 <= good < bad <= 0
    best, value = search.search_settings(px, {"height": (0.01, 3.0)}, {"least": 6}, calls=3, initial=3)
    assert set(best) == {"least", "height"} and value <= 0


def test_grid_search(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 3, [float(v) for v in x], int(x[0] > 0.5)) for i, x in enumerate(rng.random((150, 4)))]
    df = spark.createDataFrame(rows, "fold int, features array<double>, y int")
    got = {r.subset: r.f1 for r in search.grid_search(df, "features", "y", "fold", ["0.25", "1.0"], trees=5).collect()}
    assert set(got) == {"0.25", "1.0"} and got["1.0"] > 0.85


def test_evaluator_names_and_values(spark):
    from tests.test_operators import raster

    labels = [[1 + (c > 3) + 2 * (r > 3) for c in range(8)] for r in range(8)]
    same = ev.Evaluator(raster(spark, labels, labels), last=7)
    values = {r.metric: r.value for r in same.aggregate().collect()}
    assert set(values) == set(ev.RASTER + ev.OBJECT)
    assert all(values[m] == pytest.approx(1) for m in ("f1", "precision", "recall", "f1_b", "rand", "v_measure", "ssmi", "iou", "io_ref", "io_pred", "iou_boundary", "pos_sim"))
    assert all(values[m] == 0 for m in ("mae_gt", "mae_pred", "bde", "hausdorff_dist", "centroid_dist"))
    few = ev.Evaluator(raster(spark, labels, labels), ("f1", "iou"), 7)
    assert few.by_tile().columns == ["tile", "f1", "iou"] and few.objects().count() == 4
    with pytest.raises(ValueError):
        ev.Evaluator(raster(spark, labels), ("lpips",))
    pixel, objects, coco = ev.evaluation_tables(raster(spark, labels, labels), 7)
    assert pixel.first().accuracy == 1 and objects.count() == 4 and coco.first()["AP_IoU_0.50:0.95"] == pytest.approx(1)
    assert coco.first()["AP_IoU_l"] == -1


def test_forest_predicts_after_an_observation(spark):
    rows = [(float(i % 7), float(i % 3), i % 2) for i in range(60)]
    df = spark.createDataFrame([([a, b + y], y) for a, b, y in rows], "f array<double>, y int")
    df.observe(Observation(), F.count(F.lit(1)).alias("n")).collect()  # from now on the session can't be serialised
    model = models.train_forest(df, "f", "y", 5, "all")
    assert not model.hasSummary
    assert models.predict(model, df, "f").where("prediction = y").count() > 30
