"""Histogram gradient-boosted trees for a 0/1 label, flattened into node arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees as parallel arrays. Leaves point to themselves; a node goes left if its feature <= threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all trees of all rows step down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, *, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Forest:
    """Fit by second-order boosting over quantile bins.

    monotone: feature -> +1 (the score must not fall as the feature grows) or -1. A split that breaks its sign is
    refused, and the two sides' leaf values are then held apart by the middle of their values all the way down.
    No rows, or one label only: a forest without trees that gives the (smoothed) share of label 1.
    """
    monotone = monotone or {}
    n, share = len(y), (float(np.sum(y)) + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    if n and 0 < np.sum(y) < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(grow(binned, cuts, g, h, np.arange(n), depth, bins, rate, l2, least, monotone, -np.inf, np.inf, nodes, margin))
    a = np.array(nodes, dtype=float).reshape(-1, 5)
    return Forest(np.array(roots, dtype=int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], base, depth)


def grow(binned, cuts, g, h, rows, depth, bins, rate, l2, least, monotone, low, high, nodes, margin) -> int:
    """Append the subtree over rows to nodes, add its values to margin, and return its first node."""
    leaf = lambda g, h: float(np.clip(-g / (h + l2), low, high))
    me = len(nodes)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    nodes.append([0, np.inf, me, me, rate * leaf(total_g, total_h)])
    best = (1e-6, -1, -1)
    if depth and len(rows) >= 2 * least:
        width = binned.shape[1]
        cell = (binned[rows] + np.arange(width) * bins).ravel()
        sums = [np.bincount(cell, np.repeat(w, width), minlength=width * bins).reshape(width, bins).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
        with np.errstate(divide="ignore", invalid="ignore"):
            gl, hl, nl = sums
            gr, hr, nr = total_g - gl, total_h - hl, len(rows) - nl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
            wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain[(nl < least) | (nr < least)] = -1
            for f, sign in monotone.items():
                gain[f][sign * (wr[f] - wl[f]) < 0] = -1
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if b < len(cuts[f]):
            best = max(best, (gain[f, b], int(f), int(b)))
    _, f, b = best
    if f < 0:
        margin[rows] += nodes[me][4]
        return me
    goes = binned[rows, f] <= b
    sides = [(low, high), (low, high)]
    if sign := monotone.get(f, 0):
        middle = (wl[f, b] + wr[f, b]) / 2
        sides = [(low, middle), (middle, high)] if sign > 0 else [(middle, high), (low, middle)]
    kids = [grow(binned, cuts, g, h, part, depth - 1, bins, rate, l2, least, monotone, *side, nodes, margin) for part, side in zip((rows[goes], rows[~goes]), sides)]
    nodes[me] = [f, cuts[f][b], *kids, 0.0]
    return me
