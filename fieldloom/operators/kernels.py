"""Per-tile raster kernels that only make sense on a whole tile: edges, components, watershed, shapes.

Each is a numpy function on one tile and a grouped-map wrapper. A tile has a fixed number of
pixels, so a group is bounded whatever the table holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def grid(frame: pd.DataFrame, column: str, fill=np.nan) -> np.ndarray:
    """The values of a tile as an array; missing pixels are filled."""
    out = np.full((int(frame.r.max()) + 1, int(frame.c.max()) + 1), fill, float)
    out[frame.r, frame.c] = frame[column]
    return out


def shifted(a: np.ndarray, dr: int, dc: int, mode: str = "edge") -> np.ndarray:
    """a[r + dr, c + dc] with repeated edges."""
    p = np.pad(a, 1, mode=mode)
    return p[1 + dr : 1 + dr + a.shape[0], 1 + dc : 1 + dc + a.shape[1]]


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable smoothing, kernel cut at four sigma, reflected edges (the edge sample repeated)."""
    k = int(4 * sigma + 0.5)
    if not k:
        return a
    w = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        pad = [(k, k) if x == axis else (0, 0) for x in (0, 1)]
        a = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, np.pad(a, pad, mode="symmetric"))
    return a


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients along rows and columns and their magnitude."""
    def along(axis):
        step = (lambda s, t: (s, t)) if axis == 0 else (lambda s, t: (t, s))
        return sum(w * (shifted(a, *step(1, t)) - shifted(a, *step(-1, t))) for t, w in ((-1, 1), (0, 2), (1, 1)))

    i, j = along(0), along(1)
    return i, j, np.hypot(i, j)


def local_maxima(i: np.ndarray, j: np.ndarray, magnitude: np.ndarray) -> np.ndarray:
    """Non-maximum suppression along the gradient direction, in four sectors; the border is never a maximum."""
    angle = np.rad2deg(np.arctan2(i, j)) % 180
    sector = np.round(angle / 45).astype(int) % 4
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    out = np.zeros(magnitude.shape, bool)
    for s, (dr, dc) in enumerate(steps):
        higher = (magnitude >= shifted(magnitude, dr, dc)) & (magnitude >= shifted(magnitude, -dr, -dc))
        out |= (sector == s) & higher
    out[[0, -1]] = out[:, [0, -1]] = False
    return out & (magnitude > 0)


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels 1.. of connected true pixels in raster order, 0 elsewhere, by minimum propagation."""
    big = mask.size + 1
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape) + 1, big).astype(float)
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and (diagonal or not (dr and dc))]
    while True:
        padded = np.pad(label, 1, constant_values=big)
        new = label.copy()
        for dr, dc in steps:
            new = np.minimum(new, padded[1 + dr : 1 + dr + mask.shape[0], 1 + dc : 1 + dc + mask.shape[1]])
        new[~mask] = big
        if (new == label).all():
            break
        label = new
    out = np.zeros(mask.shape, int)
    values = np.unique(label[mask])
    out[mask] = np.searchsorted(values, label[mask]) + 1
    return out


def hysteresis(magnitude: np.ndarray, maxima: np.ndarray, low: float, high: float) -> np.ndarray:
    """Weak maxima that an 8-connected path of weak maxima joins to a strong one."""
    weak = maxima & (magnitude >= low)
    labels = components(weak)
    strong = np.unique(labels[weak & (magnitude >= high)])
    return weak & np.isin(labels, strong[strong > 0])


def canny(a: np.ndarray, sigma: float, low: float, high: float, quantiles: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(gradient magnitude, edge mask)."""
    i, j, magnitude = sobel(gaussian(a, sigma))
    if quantiles:
        low, high = np.nanpercentile(magnitude, [100 * low, 100 * high])
    return magnitude, hysteresis(magnitude, local_maxima(i, j, magnitude), low, high)


def watershed_cut(gradient: np.ndarray, height: float, least: int = 0) -> np.ndarray:
    """Segments of the watershed hierarchy by dynamics, cut at a height.

    Edges of the 4-neighbour graph weigh the mean of their ends and are taken in order. Two basins
    merge at an edge if the dynamics of the shallower one, the edge less its minimum, is under the
    height, or if it has fewer pixels than `least`."""
    rows, cols = gradient.shape
    at = np.arange(gradient.size).reshape(rows, cols)
    a = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()])
    b = np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    flat = gradient.ravel()
    weight = (flat[a] + flat[b]) / 2
    parent, low, size = np.arange(gradient.size), flat.copy(), np.ones(gradient.size, int)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e in np.argsort(weight, kind="stable"):
        x, y = find(a[e]), find(b[e])
        if x != y and (weight[e] - max(low[x], low[y]) < height or min(size[x], size[y]) < least):
            x, y = (x, y) if (low[x], x) <= (low[y], y) else (y, x)
            parent[y] = x
            size[x] += size[y]
    roots = np.array([find(x) for x in range(gradient.size)])
    return np.unique(roots, return_inverse=True)[1].reshape(rows, cols) + 1


def hu_moments(mask: np.ndarray) -> np.ndarray:
    """The seven moment invariants of a binary region."""
    r, c = np.nonzero(mask)
    n = len(r)
    y, x = r - r.mean(), c - c.mean()
    e = {(p, q): (y**p * x**q).sum() / n ** (1 + (p + q) / 2) for p in range(4) for q in range(4) if 2 <= p + q <= 3}
    a, b = e[3, 0] + e[1, 2], e[2, 1] + e[0, 3]
    u, v = e[3, 0] - 3 * e[1, 2], 3 * e[2, 1] - e[0, 3]
    d = e[2, 0] - e[0, 2]
    return np.array([
        e[2, 0] + e[0, 2], d * d + 4 * e[1, 1] ** 2, u * u + v * v, a * a + b * b, u * a * (a * a - 3 * b * b) + v * b * (3 * a * a - b * b),
        d * (a * a - b * b) + 4 * e[1, 1] * a * b, v * a * (a * a - 3 * b * b) - u * b * (3 * a * a - b * b),
    ])


def euler_number(mask: np.ndarray, diagonal: bool) -> int:
    """Components less holes, from counts of 2 x 2 patterns."""
    p = np.pad(mask.astype(int), 1)
    quads = np.stack([p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]])
    total = quads.sum(axis=0)
    diagonals = (total == 2) & (quads[0] == quads[3])
    q1, q3, qd = (total == 1).sum(), (total == 3).sum(), diagonals.sum()
    return int((q1 - q3 + (-2 if diagonal else 2) * qd) // 4)


def axis_lengths(mask: np.ndarray) -> tuple[float, float, float]:
    """Major and minor axis and eccentricity of the ellipse with the region's second moments."""
    r, c = np.nonzero(mask)
    y, x = r - r.mean(), c - c.mean()
    a, b, d = (y * y).mean() + 1 / 12, (x * x).mean() + 1 / 12, (x * y).mean()
    root = np.sqrt((a - b) ** 2 / 4 + d * d)
    big, small = (a + b) / 2 + root, max((a + b) / 2 - root, 0)
    return 4 * np.sqrt(big), 4 * np.sqrt(small), np.sqrt(1 - small / big)


def hull_area(mask: np.ndarray) -> float:
    """Area of the convex hull of the pixel squares."""
    r, c = np.nonzero(mask)
    points = sorted({(y + dy, x + dx) for y, x in zip(r.tolist(), c.tolist()) for dy in (0, 1) for dx in (0, 1)})

    def half(ps):
        out = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = half(points) + half(points[::-1])
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(hull, hull[1:] + hull[:1]))) / 2


def edge_distances(mask: np.ndarray, other: np.ndarray) -> tuple[float, float, float]:
    """Mean distance from the boundary pixels of one region to the other's, back, and the Hausdorff distance."""

    def rim(m):
        p = np.pad(m, 1)
        return np.argwhere(m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]))

    d = np.sqrt(((rim(mask)[:, None] - rim(other)[None]) ** 2).sum(axis=2))
    there, back = d.min(axis=1), d.min(axis=0)
    return float(there.mean()), float(back.mean()), float(max(there.max(), back.max()))


def ssim(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, span: float | None = None) -> float:
    """Mean structural similarity with Gaussian windows."""
    span = span if span is not None else max(a.max(), b.max()) - min(a.min(), b.min())
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    g = lambda x: gaussian(x, sigma)
    ma, mb = g(a), g(b)
    va, vb, cov = g(a * a) - ma * ma, g(b * b) - mb * mb, g(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def per_tile(px: DataFrame, function, schema: str) -> DataFrame:
    """Apply a function of one tile's frame."""
    return px.groupBy("tile").applyInPandas(function, schema)
