"""Masks as run lengths and as rotated boxes: encoders and decoders of single values."""

from __future__ import annotations

import numpy as np


def run_lengths(mask: np.ndarray) -> list[int]:
    """Lengths of alternating runs of zeros and ones down the columns, from a run of zeros that may be empty."""
    flat = np.asarray(mask, bool).ravel(order="F")
    turns = np.flatnonzero(np.diff(np.r_[False, flat]))
    return np.diff(np.r_[0, turns, len(flat)]).tolist()


def mask_of(lengths: list[int], height: int, width: int) -> np.ndarray:
    if sum(lengths) != height * width:
        raise ValueError("run lengths do not fill the mask")
    return np.repeat(np.arange(len(lengths)) % 2 == 1, lengths).reshape(height, width, order="F")


def text_of_lengths(lengths: list[int]) -> str:
    """Run lengths as text: from the fourth on the difference to the one before the last, in groups of
    five bits from the low end, a sixth bit where more follow, and 48 added to make a character."""
    out = []
    for k, n in enumerate(lengths):
        rest = n - lengths[k - 2] if k > 2 else n
        while True:
            group, rest = rest & 31, rest >> 5
            last = rest == (-1 if group & 16 else 0)
            out.append(chr(48 + (group if last else group | 32)))
            if last:
                break
    return "".join(out)


def lengths_of_text(text: str) -> list[int]:
    out: list[int] = []
    value = shift = 0
    for character in text:
        group = ord(character) - 48
        value |= (group & 31) << shift
        shift += 5
        if not group & 32:
            if group & 16:
                value -= 1 << shift
            out.append(value + out[-2] if len(out) > 2 else value)
            value = shift = 0
    return out


def box_of(mask: np.ndarray) -> tuple[int, int, int, int]:
    """(x, y, width, height) of a mask; zeros if it is empty."""
    r, c = np.nonzero(mask)
    return (int(c.min()), int(r.min()), int(np.ptp(c)) + 1, int(np.ptp(r)) + 1) if len(r) else (0, 0, 0, 0)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, each once."""
    rows = sorted(set(map(tuple, np.asarray(points, float).tolist())))

    def side(ps):
        out: list[tuple] = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(side(rows) + side(rows[::-1]) if len(rows) > 2 else rows)


def rotated_box(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """(centre x, centre y, width, height, angle) of the rectangle of least area around points: one of its
    sides lies on a side of the hull. The angle, in [0, pi/2), turns the x axis to the width."""
    corners = hull(points)
    if len(corners) == 1:
        return float(corners[0, 0]), float(corners[0, 1]), 0.0, 0.0, 0.0
    sides = np.roll(corners, -1, axis=0) - corners
    best = None
    for angle in sorted(set(np.round(np.arctan2(sides[:, 1], sides[:, 0]) % (np.pi / 2), 12).tolist())):
        turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
        turned = corners @ turn.T
        low, high = turned.min(axis=0), turned.max(axis=0)
        area = float(np.prod(high - low))
        if best is None or area < best[0] - 1e-9:
            best = (area, (low + high) / 2 @ turn, high - low, angle)
    _, centre, size, angle = best
    return float(centre[0]), float(centre[1]), float(size[0]), float(size[1]), float(angle)
