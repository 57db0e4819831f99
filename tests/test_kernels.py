import numpy as np
import pytest

from fieldloom.operators import kernels as k


def test_boundary_free_components_and_order():
    mask = np.array([[1, 0, 1, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 1, 0, 1]], bool)
    assert k.components(mask).tolist() == [[1, 0, 1, 1], [0, 1, 0, 0], [0, 0, 0, 2], [3, 3, 0, 2]]
    assert k.components(mask, diagonal=False).tolist() == [[1, 0, 2, 2], [0, 3, 0, 0], [0, 0, 0, 4], [5, 5, 0, 4]]


def test_sobel_of_a_ramp_and_a_constant():
    ramp = np.tile(np.arange(6.0), (6, 1))
    i, j, magnitude = k.sobel(ramp)
    assert (i == 0).all() and (j[:, 1:-1] == 8).all() and (magnitude[:, 1:-1] == 8).all()
    assert not k.sobel(np.ones((5, 5)))[2].any()


def test_canny_finds_a_step_and_no_edge_in_a_constant():
    step = np.zeros((16, 16))
    step[:, 8:] = 100
    edge = k.canny(step, 1.0, 10, 50)[1]
    assert edge[1:-1, 7:9].any(axis=1).all() and not edge[:, :5].any() and not edge[:, 11:].any()
    assert not k.canny(np.ones((8, 8)), 1.0, 1, 2)[1].any()


def test_hysteresis_keeps_weak_only_with_strong():
    magnitude = np.array([[5, 5, 9, 0, 5, 5.0]])
    assert k.hysteresis(magnitude, magnitude > 0, 4, 8).tolist() == [[True, True, True, False, False, False]]


def test_watershed_cut_by_dynamics():
    line = np.array([[0, 5, 1, 9, 0.0]])
    assert len(np.unique(k.watershed_cut(line, 0.0))) >= 3
    assert k.watershed_cut(line, 4.0).tolist()[0][0] == k.watershed_cut(line, 4.0).tolist()[0][2]
    assert len(np.unique(k.watershed_cut(line, 100.0))) == 1
    assert np.bincount(k.watershed_cut(np.random.default_rng(0).random((8, 8)), 0.0, 4).ravel())[1:].min() >= 4


def test_shapes():
    square = np.zeros((8, 8), bool)
    square[2:6, 2:6] = True
    major, minor, eccentricity = k.axis_lengths(square)
    assert major == pytest.approx(minor) and eccentricity == pytest.approx(0) and major == pytest.approx(4 * np.sqrt(16 / 12))
    assert k.hull_area(square) == 16 and k.euler_number(square, True) == k.euler_number(square, False) == 1
    ring = square.copy()
    ring[3:5, 3:5] = False
    assert k.euler_number(ring, True) == k.euler_number(ring, False) == 0
    corner = np.eye(2, dtype=bool)
    assert k.euler_number(corner, True) == 1 and k.euler_number(corner, False) == 2
    ell = np.zeros((4, 4), bool)
    ell[:, 0] = ell[3] = True
    assert k.hull_area(ell) == 11.5
    hu = k.hu_moments(square)
    assert np.allclose(k.hu_moments(np.rot90(ell)), k.hu_moments(ell)) and abs(hu[1]) < 1e-12


def test_edge_distances_and_ssim():
    a, b = np.zeros((9, 9), bool), np.zeros((9, 9), bool)
    a[1:4, 1:4] = True
    b[1:4, 3:6] = True
    there, back, hausdorff = k.edge_distances(a, b)
    assert hausdorff == 2 and there == back
    assert k.edge_distances(a, a) == (0, 0, 0)
    x = np.random.default_rng(1).random((16, 16))
    assert k.ssim(x, x) == pytest.approx(1) and k.ssim(x, 1 - x) < 0.2
