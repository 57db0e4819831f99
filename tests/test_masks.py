"""Run lengths and rotated boxes by round trips and by hand."""

import numpy as np
import pytest

from fieldloom.functions import masks as m


def test_run_lengths_by_hand():
    mask = np.array([[0, 1, 1], [0, 1, 0]])
    assert m.run_lengths(mask) == [2, 3, 1] and (m.mask_of([2, 3, 1], 2, 3) == mask).all()
    assert m.run_lengths(np.ones((1, 2))) == [0, 2] and m.run_lengths(np.zeros((2, 2))) == [4]
    # 2, 3, 1 fit five bits each; 40 is 8 with more to come, then 1; the fourth is less by 40 than the second
    assert m.text_of_lengths([2, 3, 1]) == "231" and m.text_of_lengths([40]) == chr(48 + 8 + 32) + "1"
    assert m.lengths_of_text(m.text_of_lengths([5, 100, 7, 60])) == [5, 100, 7, 60]
    with pytest.raises(ValueError):
        m.mask_of([1], 2, 2)


def test_text_round_trip():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.5, 0.98):
        for _ in range(30):
            mask = rng.random((rng.integers(1, 40), rng.integers(1, 40))) < share
            lengths = m.run_lengths(mask)
            assert m.lengths_of_text(m.text_of_lengths(lengths)) == lengths and (m.mask_of(lengths, *mask.shape) == mask).all()
            assert sum(lengths[1::2]) == mask.sum()
    assert m.box_of(np.pad(np.ones((2, 3)), 1)) == (1, 1, 3, 2) and m.box_of(np.zeros((2, 2))) == (0, 0, 0, 0)


def test_rotated_box_by_hand():
    x, y, w, h, angle = m.rotated_box([(0, 0), (4, 0), (4, 2), (0, 2), (2, 1)])
    assert (x, y, w, h, angle) == pytest.approx((2, 1, 4, 2, 0))
    x, y, w, h, angle = m.rotated_box([(0, 1), (1, 0), (3, 2), (2, 3)])
    assert (x, y) == pytest.approx((1.5, 1.5)) and sorted((w, h)) == pytest.approx([2**0.5, 8**0.5]) and angle == pytest.approx(np.pi / 4)
    assert m.rotated_box([(3, 4)]) == (3, 4, 0, 0, 0) and m.rotated_box([(0, 0), (2, 0), (4, 0)])[2:4] == pytest.approx((4, 0))


def test_rotated_box_is_the_least_of_all_angles():
    rng = np.random.default_rng(2)
    for _ in range(20):
        points = rng.random((8, 2)) * 10
        _, _, w, h, _ = m.rotated_box(points)
        for angle in np.linspace(0, np.pi / 2, 200):
            turned = points @ np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            assert w * h <= np.prod(np.ptp(turned, axis=0)) + 1e-6
