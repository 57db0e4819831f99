"""Trees of merging regions of a tile, and cuts through them; outlines of regions.

The leaves are pixels, and regions merge in the order of the dynamics of the basins between them.
A cut is a set of nodes that covers the tile. Numpy on one tile at a time."""

from __future__ import annotations

import numpy as np


class RegionTree:
    """Binary tree of merges: node n >= size has children `left` and `right`, and merged at `altitude`.

    `area` and `length` (of the outline in pixel sides, that along the tile's border included) are
    per node; children come before their parents."""

    def __init__(self, shape: tuple[int, int], left: np.ndarray, right: np.ndarray, altitude: np.ndarray, area: np.ndarray, length: np.ndarray):
        self.shape, self.size = shape, shape[0] * shape[1]
        self.left, self.right, self.altitude, self.area, self.length = left, right, altitude, area, length

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of pixel values by node."""
        out = np.r_[np.asarray(values, float).ravel(), np.zeros(len(self.left))]
        for n, (a, b) in enumerate(zip(self.left, self.right), self.size):
            out[n] = out[a] + out[b]
        return out

    def labels(self, cut: np.ndarray) -> np.ndarray:
        """Numbers 1.. in raster order of the topmost nodes that are in the cut."""
        owner = np.full(self.size + len(self.left), -1)
        for n in range(len(owner) - 1, -1, -1):
            if owner[n] < 0 and (cut[n] or n < self.size):
                owner[n] = n
            if n >= self.size and owner[n] >= 0:
                owner[self.left[n - self.size]] = owner[self.right[n - self.size]] = owner[n]
        pixels = owner[: self.size]
        first, place = np.unique(pixels, return_index=True)
        rank = np.empty(len(first), int)
        rank[np.argsort(place)] = np.arange(1, len(first) + 1)
        return rank[np.searchsorted(first, pixels)].reshape(self.shape)


def _edges(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(shape[0] * shape[1]).reshape(shape)
    return np.r_[at[:, :-1].ravel(), at[:-1].ravel()], np.r_[at[:, 1:].ravel(), at[1:].ravel()]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def region_tree(gradient: np.ndarray, least: int = 0) -> RegionTree:
    """Merges by dynamics; a merge of a region with fewer pixels than `least` counts as one at height 0."""
    flat, n = gradient.ravel(), gradient.size
    a, b = _edges(gradient.shape)
    weight = (flat[a] + flat[b]) / 2
    # the spanning tree of least weights, and how deep the shallower basin is where two meet
    parent, low, kept = np.arange(n), flat.copy(), []
    for e in np.argsort(weight, kind="stable"):
        x, y = _find(parent, a[e]), _find(parent, b[e])
        if x != y:
            kept.append((max(0.0, weight[e] - max(low[x], low[y])), e))
            x, y = (x, y) if (low[x], x) <= (low[y], y) else (y, x)
            parent[y] = x
    kept.sort()

    def merged(order):
        parent, top, area = np.arange(n), np.arange(n), np.r_[np.ones(n, int), np.zeros(n - 1, int)]
        left, right = np.zeros(n - 1, int), np.zeros(n - 1, int)
        for k, (_, e) in enumerate(order):
            x, y = _find(parent, a[e]), _find(parent, b[e])
            left[k], right[k] = top[x], top[y]
            area[n + k] = area[top[x]] + area[top[y]]
            x, y = (x, y) if area[top[x]] >= area[top[y]] else (y, x)
            parent[y], top[x] = x, n + k
        return left, right, area

    left, right, area = merged(kept)
    if least:
        small = np.minimum(area[left], area[right]) < least
        kept = sorted((0.0 if s else d, k, e) for k, (s, (d, e)) in enumerate(zip(small, kept)))
        kept = [(d, e) for d, _, e in kept]
        left, right, area = merged(kept)
    return RegionTree(gradient.shape, left, right, np.r_[np.zeros(n), [d for d, _ in kept]], area, _lengths(gradient.shape, left, right))


def _lengths(shape: tuple[int, int], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Outline of every node: those of its children less twice the sides between them, found at the
    lowest node that holds both pixels of a side."""
    n = shape[0] * shape[1]
    up = np.arange(2 * n - 1)
    up[left] = up[right] = np.arange(n, 2 * n - 1)
    depth = np.zeros(2 * n - 1, int)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[up[k]] + 1
    a, b = _edges(shape)
    x, y = a.copy(), b.copy()
    while (x != y).any():
        lower = depth[x] >= depth[y]
        x, y = np.where((x != y) & lower, up[x], x), np.where((x != y) & ~lower, up[y], y)
    inner = np.bincount(x, minlength=2 * n - 1)
    out = np.r_[np.full(n, 4), np.zeros(n - 1, int)]
    for k in range(n - 1):
        out[n + k] = out[left[k]] + out[right[k]] - 2 * inner[n + k]
    return out


def dynamics_cut(tree: RegionTree, height: float) -> np.ndarray:
    """Regions that merge under a height."""
    return tree.labels(tree.altitude < height)


def compactness(tree: RegionTree) -> np.ndarray:
    """4 pi area / length squared by node."""
    return 4 * np.pi * tree.area / tree.length.astype(float) ** 2


def combined_cut(tree: RegionTree, height: float, weight: float) -> np.ndarray:
    """Regions that merge under a height of the mean of dynamics and compactness: the contour between two
    regions weighs the larger compactness of the two, by how high in the tree they are."""
    rise = np.zeros(len(tree.area))
    for k, (a, b) in enumerate(zip(tree.left, tree.right), tree.size):
        rise[k] = max(rise[a], rise[b]) + 1
    shape = compactness(tree) * rise / max(rise.max(), 1)
    shape[: tree.size] = 0
    saliency = np.zeros(len(tree.area))
    for k, (a, b) in enumerate(zip(tree.left, tree.right), tree.size):
        own = (tree.altitude[k] + weight * max(shape[a], shape[b])) / (1 + weight)
        saliency[k] = max(own, saliency[a], saliency[b])  # a cut must be one of the tree
    return tree.labels(saliency < height)


def energy_cut(tree: RegionTree, fidelity: np.ndarray, regularity: np.ndarray, scale: float) -> np.ndarray:
    """The cut of least total energy fidelity + scale * regularity, from the leaves to the root; of equal
    ones the coarser. This is the cut at `scale` of the hierarchy of all optimal cuts."""
    own = fidelity + scale * regularity
    best, whole = own.copy(), np.ones(len(own), bool)
    for k, (a, b) in enumerate(zip(tree.left, tree.right), tree.size):
        parts = best[a] + best[b]
        whole[k] = own[k] <= parts + 1e-12
        best[k] = min(own[k], parts)
    return tree.labels(whole)


def spread_within(tree: RegionTree, values: np.ndarray) -> np.ndarray:
    """Sum of squared differences from the mean by node."""
    s = tree.sums(values)
    return np.maximum(tree.sums(values**2) - s * s / tree.area, 0)


def piecewise_constant_cut(tree: RegionTree, values: np.ndarray, scale: float) -> np.ndarray:
    """After Mumford and Shah: spread within regions against the length of their outlines."""
    return energy_cut(tree, spread_within(tree, values), tree.length.astype(float), scale)


def compact_energy_cut(tree: RegionTree, values: np.ndarray, scale: float) -> np.ndarray:
    """Spread within regions against their compactness."""
    return energy_cut(tree, spread_within(tree, values), compactness(tree), scale)


METHODS = ("dynamics_hcut", "combined_hcut", "compact_energy_cut", "ms_energy_cut")


def segment(gradient: np.ndarray, method: str = "dynamics_hcut", height: float = 0.1, least: int = 25, values: np.ndarray | None = None, weight: float = 0.5) -> np.ndarray:
    """Labels 1.. of a tile by one of the cuts; `values` are the means that the energy cuts compare."""
    tree = region_tree(gradient, least)
    if method == "dynamics_hcut":
        return dynamics_cut(tree, height)
    if method == "combined_hcut":
        return combined_cut(tree, height, weight)
    if method == "compact_energy_cut":
        return compact_energy_cut(tree, values, height)
    if method == "ms_energy_cut":
        return piecewise_constant_cut(tree, values, height)
    raise ValueError(f"unknown method {method}; known are {', '.join(METHODS)}")


def rings(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines (row, column of corners) of the pixel squares of a mask; the mask lies to the
    right of each side, so outer rings have positive area. Straight runs are one side."""
    p = np.pad(mask, 1)
    follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (dr, dc), start, end in (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))):
        outside = ~p[1 + dr : 1 + dr + mask.shape[0], 1 + dc : 1 + dc + mask.shape[1]]
        for r, c in np.argwhere(mask & outside).tolist():
            follow.setdefault((r + start[0], c + start[1]), []).append((r + end[0], c + end[1]))
    out = []
    while follow:
        first = min(follow)
        ring, here, came = [first], first, None
        while True:
            ways = follow[here]
            if came and len(ways) > 1:  # where pixels meet at a corner only, turn to stay with the same one
                turn = (came[1], -came[0])
                ways.sort(key=lambda w: (w[0] - here[0], w[1] - here[1]) != turn)
            there = ways.pop(0)
            if not ways:
                del follow[here]
            came = (there[0] - here[0], there[1] - here[1])
            here = there
            if here == first:
                break
            ring.append(here)
        ring = np.array(ring)
        before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        out.append(ring[(before != after).any(axis=1)])
    return out


def ring_area(ring: np.ndarray) -> float:
    r, c = ring.T.astype(float)
    return float((c * np.roll(r, -1) - np.roll(c, -1) * r).sum() / 2)


def outer_rings(mask: np.ndarray) -> list[np.ndarray]:
    return [x for x in rings(mask) if ring_area(x) > 0]


def boundary_points(mask: np.ndarray, step: float = 2.5) -> np.ndarray:
    """Points every `step` pixels along the outer outlines, each once."""
    found = []
    for ring in outer_rings(mask):
        sides = np.roll(ring, -1, axis=0) - ring
        length = np.abs(sides).sum(axis=1).astype(float)
        ends = np.cumsum(length)
        at = np.arange(0, ends[-1], step)
        side = np.searchsorted(ends, at, "right")
        share = (at - (ends[side] - length[side])) / length[side]
        found.append(ring[side] + sides[side] * share[:, None])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2))


def distances_to_outline(points: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest place of a mask's outlines, holes included."""
    a = np.concatenate(rings(mask)).astype(float)
    b = np.concatenate([np.roll(x, -1, axis=0) for x in rings(mask)]).astype(float)
    along = b - a
    share = np.clip(((points[:, None] - a) * along).sum(axis=2) / (along**2).sum(axis=1), 0, 1)
    return np.sqrt(((a + share[:, :, None] * along - points[:, None]) ** 2).sum(axis=2)).min(axis=1)


def outline_distances(mask: np.ndarray, other: np.ndarray, step: float = 2.5) -> tuple[float, float, float]:
    """Mean distance from points of one outline to the other's, back, and the Hausdorff distance
    between corners of one and the outline of the other."""
    there = distances_to_outline(boundary_points(mask, step), other).mean()
    back = distances_to_outline(boundary_points(other, step), mask).mean()
    corners = [distances_to_outline(np.concatenate(rings(x)).astype(float), y).max() for x, y in ((mask, other), (other, mask))]
    return float(there), float(back), float(max(corners))


def simplified(ring: np.ndarray, epsilon: float) -> np.ndarray:
    """Corners that stay after Douglas and Peucker, from the first corner and the one farthest from it."""
    keep = np.zeros(len(ring) + 1, bool)
    closed = np.r_[ring, ring[:1]].astype(float)
    far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    keep[[0, far, -1]] = True
    open_ = [(0, far), (far, len(ring))]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        line, inner = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        size = np.hypot(*line)
        away = np.abs(line[0] * inner[:, 1] - line[1] * inner[:, 0]) / size if size else np.hypot(*inner.T)
        k = int(away.argmax())
        if away[k] > epsilon:
            keep[a + 1 + k] = True
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return closed[keep][:-1]


def inside(polygon: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centres lie in a polygon, by crossings of a line to the right."""
    r, c = np.indices(shape) + 0.5
    out = np.zeros(shape, bool)
    for (r0, c0), (r1, c1) in zip(polygon, np.roll(polygon, -1, axis=0)):
        if r0 != r1:
            crosses = (np.minimum(r0, r1) <= r) & (r < np.maximum(r0, r1))
            out ^= crosses & (c < c0 + (r - r0) * (c1 - c0) / (r1 - r0))
    return out


def smoothed_labels(labels: np.ndarray, epsilon: float) -> np.ndarray:
    """Regions drawn anew from their simplified outer outlines, small ones over large ones; what no
    outline covers keeps its label."""
    out = labels.copy()
    numbers, sizes = np.unique(labels, return_counts=True)
    for label in numbers[np.argsort(-sizes, kind="stable")]:
        for ring in outer_rings(labels == label):
            polygon = simplified(ring, epsilon)
            if len(polygon) > 2:
                out[inside(polygon, labels.shape)] = label
    return out


def polygon_text(mask: np.ndarray) -> str:
    """The region as a multipolygon in text form (x is the column, y the row), each outer ring with its holes."""
    all_ = rings(mask)
    outer = [x for x in all_ if ring_area(x) > 0]
    holes = [x for x in all_ if ring_area(x) < 0]
    shown = lambda x: "(" + ", ".join(f"{c} {r}" for r, c in [*x.tolist(), x[0].tolist()]) + ")"
    parts = []
    for ring in outer:
        cover = inside(ring.astype(float), mask.shape)
        own = [h for h in holes if cover[min(h[:, 0].min(), mask.shape[0] - 1), min(h[h[:, 0] == h[:, 0].min(), 1].min(), mask.shape[1] - 1)]]
        parts.append("(" + ", ".join(map(shown, [ring, *own])) + ")")
    return "MULTIPOLYGON (" + ", ".join(parts) + ")"
