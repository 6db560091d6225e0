"""Histogram gradient-boosted trees for a binary label, in numpy.

Trees grow level by level over binned features; a fitted forest is a set of flat arrays that all
rows descend together, one level a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """`feature` is -1 at leaves, whose children point back at themselves; roots[t] starts tree t."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between distinct values, at most bins - 1 of them at even quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 5, rate: float = 0.1, bins: int = 64, min_rows: int = 20, ridge: float = 1.0
) -> Forest:
    """Second-order boosting of the logistic loss. One class only or no rows: a constant forest."""
    y = np.asarray(y, float)
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def new_node() -> int:
        k = len(nodes["feature"])
        for name, v in (("feature", -1), ("threshold", 0.0), ("left", k), ("right", k), ("value", 0.0)):
            nodes[name].append(v)
        return k

    if len(y) and 0 < y.mean() < 1:
        cuts = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        width = max(len(c) for c in cuts) + 1
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            root = new_node()
            roots.append(root)
            level, slot = [root], np.zeros(len(y), np.int64)
            leaf_of = np.full(len(y), root)
            for _ in range(depth):
                live = slot >= 0
                n, size = len(level), len(level) * width
                g_all = np.bincount(slot[live], grad[live], n)
                h_all = np.bincount(slot[live], hess[live], n)
                best = np.full(n, 1e-6)
                where = np.full((n, 2), -1)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = slot[live] * width + binned[live, j]
                    gl, hl, cl = (np.cumsum(np.bincount(key, w, size).reshape(n, width), axis=1)[:, : len(c)] for w in (grad[live], hess[live], None))
                    gr, hr, rows = g_all[:, None] - gl, h_all[:, None] - hl, np.bincount(slot[live], minlength=n)[:, None]
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g_all**2 / (h_all + ridge))[:, None]
                    gain[(cl < min_rows) | (rows - cl < min_rows)] = -1
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(n), k]
                    better = top > best
                    best[better], where[better] = top[better], np.stack([np.full(n, j), k], axis=1)[better]
                nxt: list[int] = []
                child = np.full((n, 2), -1)
                for s, node in enumerate(level):
                    j, k = where[s]
                    if j >= 0:
                        a, b = new_node(), new_node()
                        nodes["feature"][node], nodes["threshold"][node] = int(j), float(cuts[j][k])
                        nodes["left"][node], nodes["right"][node] = a, b
                        child[s] = len(nxt), len(nxt) + 1
                        nxt += [a, b]
                if not nxt:
                    break
                j, k = where[np.maximum(slot, 0)].T
                side = (binned[np.arange(len(y)), np.maximum(j, 0)] > k).astype(int)
                slot = np.where(slot >= 0, child[np.maximum(slot, 0), side], -1)
                leaf_of = np.where(slot >= 0, np.asarray(nxt)[np.maximum(slot, 0)], leaf_of)
                level = nxt
            g_leaf = np.bincount(leaf_of, grad, len(nodes["value"]))
            h_leaf = np.bincount(leaf_of, hess, len(nodes["value"]))
            for leaf in np.unique(leaf_of):
                nodes["value"][leaf] = float(-rate * g_leaf[leaf] / (h_leaf[leaf] + ridge))
            margin += np.asarray(nodes["value"])[leaf_of]
    return Forest(base, np.asarray(roots, np.int64), depth=depth, **{k: np.asarray(v, float if k in ("threshold", "value") else np.int64) for k, v in nodes.items()})
