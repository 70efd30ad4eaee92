"""Gradient-boosted regression trees on binned features, with monotonic constraints, as flat arrays.

Fitting takes a bounded sample on the driver; scoring walks all trees for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees, one after the other; a leaf's children are the leaf itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for the rows of x."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def constant(probability: float) -> Trees:
    """A model without trees."""
    none = np.zeros(0, dtype=np.int64)
    p = min(max(probability, 1e-6), 1 - 1e-6)
    return Trees(none, none.astype(float), none, none, none.astype(float), none, 0, float(np.log(p / (1 - p))))


def fit(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
    bins: int = 48, smooth: float = 1.0, least: float = 1.0,
) -> Trees:
    """Fit log-loss by Newton steps. monotone has +1, -1 or 0 for each feature.

    A constrained split must order its two values, and the middle of the two bounds what is below it, so
    that the sum of trees is monotone in the feature.
    """
    n, k = x.shape
    if n == 0 or y.min() == y.max():
        return constant(float(y.mean()) if n else 0.5)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1)
    width = bins + 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        open_nodes = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for level in range(depth + 1):
            below = []
            for at, rows, low, high in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes[at][4] = rate * float(np.clip(gs / (hs + smooth), low, high))
                margin[rows] += nodes[at][4] if level == depth else 0.0
                split = None if level == depth else _best(binned, g, h, rows, cuts, monotone, width, low, high, smooth, least)
                if split is None:
                    if level < depth:
                        margin[rows] += nodes[at][4]
                    continue
                j, cut, vl, vr = split
                go = binned[rows, j] <= cut
                first = len(nodes)
                nodes[at][:4] = [j, float(cuts[j][cut]), first, first + 1]
                nodes += [[0, 0.0, first, first, 0.0], [0, 0.0, first + 1, first + 1, 0.0]]
                middle = (vl + vr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
                (ll, lh), (rl, rh) = bounds[int(monotone[j])]
                below += [(first, rows[go], ll, lh), (first + 1, rows[~go], rl, rh)]
            open_nodes = below
    flat = np.array(nodes)
    whole = [flat[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Trees(whole[0], flat[:, 1], whole[1], whole[2], flat[:, 4], np.array(roots), depth, base)


def _best(binned, g, h, rows, cuts, monotone, width, low, high, smooth, least):
    """The split of largest gain as (feature, cut, left value, right value), or None."""
    best, found = 1e-6, None
    gs, hs = g[rows].sum(), h[rows].sum()
    score = lambda a, b, v: 2 * a * v - (b + smooth) * v * v
    parent = score(gs, hs, np.clip(gs / (hs + smooth), low, high))
    for j, own in enumerate(cuts):
        if not len(own):
            continue
        b = binned[rows, j]
        gl = np.bincount(b, weights=g[rows], minlength=width)[: len(own)].cumsum()
        hl = np.bincount(b, weights=h[rows], minlength=width)[: len(own)].cumsum()
        gr, hr = gs - gl, hs - hl
        vl, vr = np.clip(gl / (hl + smooth), low, high), np.clip(gr / (hr + smooth), low, high)
        gain = score(gl, hl, vl) + score(gr, hr, vr) - parent
        gain[(hl < least) | (hr < least) | ((vr - vl) * monotone[j] < 0)] = -np.inf
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = float(gain[at]), (j, at, float(vl[at]), float(vr[at]))
    return found
