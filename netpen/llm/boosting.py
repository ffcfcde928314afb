"""Gradient-boosted trees for two classes, grown on binned features; small enough for a driver."""

from __future__ import annotations

import numpy as np


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32,
          least: int = 20, ridge: float = 1.0) -> dict:
    """Logistic loss; every tree is complete to ``depth``, unsplittable nodes send all rows left."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    width = max((len(c) for c in cuts), default=0) + 1
    rate_y = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_y / (1 - rate_y)))
    score = np.full(len(y), base)
    model = {"base": base, "depth": depth, "axis": [], "cut": [], "leaf": []}
    flat = (binned + np.arange(x.shape[1]) * width).astype(np.int64)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        axes, values = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            for at in range(2 ** level):
                rows = np.flatnonzero(node == at)
                place = 2 ** level - 1 + at
                if len(rows) < 2 * least:
                    continue
                cells = flat[rows].ravel()
                shape = (x.shape[1], width)
                count, grad, hess = (
                    np.bincount(cells, None if w is None else np.repeat(w[rows], x.shape[1]),
                                x.shape[1] * width).reshape(shape).cumsum(axis=1)[:, :-1] for w in (None, g, h))
                gs, hs = g[rows].sum(), h[rows].sum()
                gain = grad ** 2 / (hess + ridge) + (gs - grad) ** 2 / (hs - hess + ridge) - gs ** 2 / (hs + ridge)
                gain[(count < least) | (len(rows) - count < least)] = 0
                best = int(np.argmax(gain))
                axis, cut = divmod(best, width - 1)
                if gain[axis, cut] <= 1e-6 or cut >= len(cuts[axis]):
                    continue
                axes[place], values[place] = axis, cuts[axis][cut]
            node = 2 * node + (x[np.arange(len(y)), axes[2 ** level - 1 + node]] > values[2 ** level - 1 + node])
        leaf = rate * np.bincount(node, g, 2 ** depth) / (np.bincount(node, h, 2 ** depth) + ridge)
        score += leaf[node]
        model["axis"].append(axes), model["cut"].append(values), model["leaf"].append(leaf)
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds."""
    score = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for axes, cuts, leaf in zip(model["axis"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for level in range(model["depth"]):
            place = 2 ** level - 1 + node
            node = 2 * node + (x[rows, axes[place]] > cuts[place])
        score += leaf[node]
    return score
