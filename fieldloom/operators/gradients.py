"""Edge strength of multi-band tiles: interpolated non-maximum suppression, the colour structure
tensor, four ways to combine bands, and adaptive contrast. Numpy on one tile at a time."""

from __future__ import annotations

import numpy as np

from fieldloom.operators import kernels as k

STRATEGIES = ("post_avg_crisp", "post_avg_soft", "pre_avg_soft", "rgb_post_avg_soft")


def smoothed(stack: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along all axes of a stack of bands, the band axis included."""
    out = np.stack([k.gaussian(band, sigma) for band in stack])
    reach = int(4 * sigma + 0.5)
    if not reach or not len(out):
        return out
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    period = np.r_[np.arange(len(out)), np.arange(len(out))[::-1]]  # reflected, the edge band repeated
    places = period[(np.arange(len(out))[:, None] + np.arange(-reach, reach + 1)) % len(period)]
    return np.einsum("bk,bkrc->brc", np.broadcast_to(weights / weights.sum(), places.shape), out[places])


def maxima_along(i: np.ndarray, j: np.ndarray, magnitude: np.ndarray) -> np.ndarray:
    """Pixels not below their surroundings on the line of the gradient (i down, j right).

    The line leaves the 3 x 3 window at two places, where the magnitude is interpolated between
    the straight and the diagonal neighbour. The border is never a maximum."""
    steep = np.abs(i) >= np.abs(j)
    most = np.where(steep, np.abs(i), np.abs(j))
    share = np.divide(np.where(steep, np.abs(j), np.abs(i)), most, out=np.zeros(most.shape), where=most > 0)
    di, dj = np.sign(i).astype(int), np.sign(j).astype(int)
    rows, cols = np.indices(magnitude.shape) + 1
    wide = np.pad(magnitude, 1, mode="edge")
    ok = magnitude > 0
    for side in (1, -1):
        straight = wide[rows + side * np.where(steep, di, 0), cols + side * np.where(steep, 0, dj)]
        slanted = wide[rows + side * di, cols + side * dj]
        ok &= magnitude >= straight * (1 - share) + slanted * share
    ok[[0, -1]] = ok[:, [0, -1]] = False
    return ok


def edge_strength(i: np.ndarray, j: np.ndarray, magnitude: np.ndarray, low: float, high: float) -> np.ndarray:
    """The magnitude on edges and zero elsewhere; thresholds are quantiles of the magnitude."""
    low, high = np.nanpercentile(magnitude, [100 * low, 100 * high])
    return np.where(k.hysteresis(magnitude, maxima_along(i, j, magnitude), low, high), magnitude, 0.0)


def canny_strength(band: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    return edge_strength(*k.sobel(k.gaussian(band, sigma)), low, high)


def tensor_gradient(bands: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(magnitude, direction) of the most prominent change over all bands: root of the largest
    eigenvalue of the smoothed structure tensor, and the angle of its axis."""
    gy, gx = np.zeros((2, *bands.shape))
    for n, band in enumerate(smoothed(bands, sigma)):
        gy[n], gx[n], _ = k.sobel(band)
    xx, yy, xy = (k.gaussian((a * b).sum(axis=0), sigma) for a, b in ((gx, gx), (gy, gy), (gx, gy)))
    spread = np.sqrt((xx - yy) ** 2 + (2 * xy) ** 2 + 1e-9)
    return np.sqrt(xx + yy + spread + 1e-9), 0.5 * np.arctan2(2 * xy, xx - yy)


def colour_edges(bands: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Edge strength of a colour composite."""
    magnitude, angle = tensor_gradient(bands, sigma)
    return edge_strength(magnitude * np.sin(angle), magnitude * np.cos(angle), magnitude, low, high)


def combined_gradient(cube: np.ndarray, method: str, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """One edge map of a cube (band, date, row, column) with bands blue, green, red, near infrared, index.

    Edges of every layer are averaged as marks (post_avg_crisp) or as strengths (post_avg_soft); or
    gradients are averaged before edges are sought (pre_avg_soft); or the strengths of the true and
    false colour composites of all dates are averaged (rgb_post_avg_soft). The border is set to 1."""
    layers = cube.reshape(-1, *cube.shape[2:])
    if method in ("post_avg_crisp", "post_avg_soft"):
        found = np.stack([canny_strength(x, sigma, low, high) for x in layers])
        out = (found > 0 if method == "post_avg_crisp" else found).mean(axis=0)
    elif method == "pre_avg_soft":
        i, j, magnitude = (np.mean(x, axis=0) for x in zip(*(k.sobel(k.gaussian(x, sigma)) for x in layers)))
        out = edge_strength(i, j, magnitude, low, high)
    elif method == "rgb_post_avg_soft":
        out = np.mean([colour_edges(255 * cube[bands, t], sigma, low, high) for t in range(cube.shape[1]) for bands in ([2, 1, 0], [3, 2, 1])], axis=0)
    else:
        raise ValueError(f"unknown method {method}; known are {', '.join(STRATEGIES)}")
    out = out.astype(float)
    out[[0, -1]] = out[:, [0, -1]] = 1
    return out


def adaptive_contrast(band: np.ndarray, size: int = 64, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of values in [0, 1].

    Every block of `size` pixels has its own cumulative histogram, whose bars are cut at a share of
    the block and the cut part dealt to all bars; a pixel gets the bilinear mean of the four blocks
    whose centres surround it."""
    rows, cols = band.shape
    level = np.clip((band * (bins - 1)).round().astype(int), 0, bins - 1)
    high, wide = -(-rows // size), -(-cols // size)
    maps = np.empty((high, wide, bins))
    for r in range(high):
        for c in range(wide):
            counts = np.bincount(level[r * size : (r + 1) * size, c * size : (c + 1) * size].ravel(), minlength=bins).astype(float)
            most = max(1.0, clip * counts.sum())
            over = np.maximum(counts - most, 0).sum()
            maps[r, c] = np.cumsum(np.minimum(counts, most) + over / bins) / counts.sum()

    def between(n: int, blocks: int):
        at = np.clip((np.arange(n) + 0.5) / size - 0.5, 0, blocks - 1)
        first = np.minimum(at.astype(int), max(blocks - 2, 0))
        return first, np.minimum(first + 1, blocks - 1), at - first

    (r0, r1, rw), (c0, c1, cw) = between(rows, high), between(cols, wide)
    pick = lambda r, c: maps[r[:, None], c[None, :], level]
    top = pick(r0, c0) * (1 - cw) + pick(r0, c1) * cw
    low = pick(r1, c0) * (1 - cw) + pick(r1, c1) * cw
    return top * (1 - rw[:, None]) + low * rw[:, None]
