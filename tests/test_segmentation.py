"""Edges, region trees, cuts and outlines on worked examples."""

import math

import numpy as np
import pytest

from fieldloom.operators import gradients as g
from fieldloom.operators import kernels as k
from fieldloom.operators import segmentation as s


def test_interpolated_maxima_of_a_ramp():
    """A ridge along a diagonal is found by interpolation; the flat parts and the border are not."""
    r, c = np.indices((9, 9))
    ridge = np.exp(-((r - c) ** 2) / 2.0)
    i, j, _ = k.sobel(ridge)
    found = g.maxima_along(np.where(i == 0, 1, 1), np.full((9, 9), -1.0), ridge)
    assert all(found[n, n] for n in range(1, 8)) and not found[[0, -1]].any()
    assert not found[3, 5] and not found[5, 2]
    half = np.array([[0, 0, 0], [0, 2, 0], [0, 1, 5]], float)  # gradient (2, 1): half way between 1 and 5
    assert not g.maxima_along(np.full((3, 3), 2.0), np.full((3, 3), 1.0), half)[1, 1]
    assert g.maxima_along(np.full((3, 3), 4.0), np.full((3, 3), 1.0), half)[1, 1]  # a quarter: 2


def test_tensor_follows_one_band_and_adds_two():
    step = np.zeros((12, 12))
    step[:, 6:] = 1
    one, angle = g.tensor_gradient(np.stack([step, 0 * step, 0 * step]), 0.0)
    assert one[5, 5] == pytest.approx(np.sqrt(2) * 4, abs=1e-3) and angle[5, 5] == pytest.approx(0)
    two, _ = g.tensor_gradient(np.stack([step, step, 0 * step]), 0.0)
    assert two[5, 5] == pytest.approx(np.sqrt(2) * one[5, 5], abs=1e-3)


def test_strategies_mark_the_step():
    cube = np.zeros((5, 6, 20, 20))
    cube[:, :, :, 10:] = 0.5
    cube[4] = 0.1
    for method in g.STRATEGIES:
        out = g.combined_gradient(cube, method, 1.0, 0.1, 0.2)
        inner = out[3:-3, 3:-3]
        assert inner[:, 5:9].max() > 0 and inner[:, :3].max() == 0 and (out[0] == 1).all() and (out[:, -1] == 1).all(), method
    assert g.combined_gradient(cube, "post_avg_crisp")[8, 9:11].max() == pytest.approx(0.8)  # 24 of 30 layers
    with pytest.raises(ValueError):
        g.combined_gradient(cube, "other")


def test_adaptive_contrast():
    ramp = np.tile(np.linspace(0, 1, 32), (32, 1))
    whole = g.adaptive_contrast(ramp, 32, clip=1.0)
    assert np.allclose(whole[0], (np.arange(32) + 1) / 32)  # one block, no clipping: plain equalisation
    out = g.adaptive_contrast(ramp, 8)
    assert out.shape == ramp.shape and 0 <= out.min() and out.max() <= 1
    flat = g.adaptive_contrast(np.full((8, 8), 0.5), 8, clip=0.01)
    assert np.ptp(flat) == 0


VALLEYS = np.array([[0, 0, 4, 1, 1, 9, 0, 0]] * 3, float)


def test_dynamics_cut_by_hand():
    """The middle valley is 2.5 - 1 deep against the left one, and the right one 5 - 1 against the two."""
    tree = s.region_tree(VALLEYS)
    for height, n in ((0.5, 3), (1.6, 2), (3.0, 2), (6.0, 1)):
        assert len(np.unique(s.dynamics_cut(tree, height))) >= n
    two = s.dynamics_cut(tree, 3.0)
    assert two[0, 0] == two[0, 3] != two[0, 7]
    assert (s.dynamics_cut(tree, 100) == 1).all()


def test_tree_sums_and_outlines_match_masks():
    rng = np.random.default_rng(3)
    gradient = rng.random((6, 7))
    tree = s.region_tree(gradient, 3)
    values = rng.random((6, 7))
    members = [{n} for n in range(tree.size)]
    for a, b in zip(tree.left, tree.right):
        members.append(members[a] | members[b])
    for n in range(len(members)):
        mask = np.zeros(42, bool)
        mask[list(members[n])] = True
        mask = mask.reshape(6, 7)
        p = np.pad(mask, 1)
        sides = sum((mask & ~p[1 + i : 7 + i, 1 + j : 8 + j]).sum() for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert tree.area[n] == mask.sum() and tree.length[n] == sides
        assert tree.sums(values)[n] == pytest.approx(values[mask].sum())
    assert (np.diff(tree.altitude[tree.size :]) >= 0).all()


def test_energy_cut_is_the_best_of_all_cuts():
    rng = np.random.default_rng(5)
    tree = s.region_tree(rng.random((2, 4)))
    values = rng.random((2, 4))

    def cuts(n):
        yield [n]
        if n >= tree.size:
            for a in cuts(tree.left[n - tree.size]):
                for b in cuts(tree.right[n - tree.size]):
                    yield a + b

    for scale in (0.0, 0.002, 0.01, 0.05, 1.0):
        energy = s.spread_within(tree, values) + scale * tree.length
        best = min(cuts(len(tree.area) - 1), key=lambda c: (round(sum(energy[c]), 10), len(c)))
        assert len(np.unique(s.piecewise_constant_cut(tree, values, scale))) == len(best)


def test_all_methods_cover_the_tile():
    rng = np.random.default_rng(6)
    gradient, values = rng.random((12, 12)), rng.random((12, 12))
    for method in s.METHODS:
        labels = s.segment(gradient, method, 0.2, 5, values)
        assert labels.min() == 1 and set(np.unique(labels)) == set(range(1, labels.max() + 1))
        for n in np.unique(labels):
            assert k.components(labels == n, diagonal=False).max() == 1


def test_small_regions_merge_first():
    labels = s.segment(np.random.default_rng(1).random((10, 10)), "dynamics_hcut", 1e-9, 8)
    assert np.bincount(labels.ravel())[1:].min() >= 8


def test_rings_points_and_text_by_hand():
    mask = np.zeros((5, 5), bool)
    mask[1:4, 1:4] = True
    mask[2, 2] = False
    found = s.rings(mask)
    assert sorted(s.ring_area(x) for x in found) == [-1, 9] and sum(map(s.ring_area, found)) == mask.sum()
    assert s.polygon_text(mask) == "MULTIPOLYGON (((1 1, 4 1, 4 4, 1 4, 1 1), (2 2, 2 3, 3 3, 3 2, 2 2)))"
    points = s.boundary_points(mask, 2.5)
    assert len(points) == 5 and [1, 1] in points.tolist() and [1, 3.5] in points.tolist()
    corner = np.eye(3, dtype=bool)
    assert sum(map(s.ring_area, s.rings(corner))) == 3 and len(s.outer_rings(corner)) >= 1


def test_outline_distances_by_hand():
    a, b = np.zeros((6, 9), bool), np.zeros((6, 9), bool)
    a[1:3, 1:3], b[1:3, 1:5] = True, True
    there, back, hausdorff = s.outline_distances(a, b, 1.0)
    # of the eight points of the square only that in the middle of its right side is off the other outline
    assert there == pytest.approx(1 / 8) and hausdorff == pytest.approx(2)
    assert s.outline_distances(a, a) == (0, 0, 0)


def test_simplification():
    ring = np.array([[0, 0], [0, 4], [1, 4], [1, 5], [5, 5], [5, 0]])
    assert len(s.simplified(ring, 0)) == 6 and len(s.simplified(ring, 1.2)) == 4
    labels = np.ones((8, 8), int)
    labels[:, 4:] = 2
    assert (s.smoothed_labels(labels, 0) == labels).all() and (s.smoothed_labels(labels, 1) == labels).all()
    assert s.inside(np.array([[0, 0], [0, 4], [4, 4], [4, 0]], float), (5, 5)).sum() == 16
    assert math.isclose(s.inside(np.array([[0, 0], [0, 8], [8, 0]], float), (8, 8)).sum(), 28, abs_tol=8)
