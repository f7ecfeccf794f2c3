"""Gradient boosting of shallow regression trees for a yes-or-no label, on small samples in memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Trees of equal depth as arrays: node k of a tree goes on to 2k+1 where its feature is at most the cut, else 2k+2."""

    base: float
    features: np.ndarray  # (trees, inner nodes)
    cuts: np.ndarray
    leaves: np.ndarray  # (trees, leaves)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of a yes for each row."""
        total = np.full(len(rows), self.base)
        inner = self.features.shape[1]
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(rows), np.int64)
            while (node < inner).all() and len(node):
                node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; cuts are tried at up to 16 quantiles of each feature."""
    labels = labels.astype(float)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    grid = [np.unique(np.quantile(column, np.linspace(0, 1, 17)[:-1])) for column in rows.T]
    total = np.full(len(rows), base)
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        gradient, weight = labels - p, np.maximum(p * (1 - p), 1e-9)
        features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            if len(at):
                features[k], cuts[k] = best_cut(rows[at], gradient[at], weight[at], grid, penalty)
            node[at] = 2 * k + 1 + (rows[at, features[k]] > cuts[k])
        place = node - inner
        up = np.bincount(place, weights=gradient, minlength=inner + 1)
        down = np.bincount(place, weights=weight, minlength=inner + 1)
        leaves = rate * up / (down + penalty)
        total += leaves[place]
        all_features.append(features)
        all_cuts.append(cuts)
        all_leaves.append(leaves)
    return Trees(base, np.array(all_features), np.array(all_cuts), np.array(all_leaves))


def best_cut(rows, gradient, weight, grid, penalty) -> tuple[int, float]:
    """The feature and cut with the largest gain; a cut at infinity if none gains."""
    best, found = 1e-9, (0, np.inf)
    g, h = gradient.sum(), weight.sum()
    whole = g * g / (h + penalty)
    for feature, cuts in enumerate(grid):
        if len(cuts) < 2:
            continue
        place = np.searchsorted(cuts, rows[:, feature], side="left")
        left_g = np.cumsum(np.bincount(place, weights=gradient, minlength=len(cuts) + 1))[: len(cuts)]
        left_h = np.cumsum(np.bincount(place, weights=weight, minlength=len(cuts) + 1))[: len(cuts)]
        gain = left_g**2 / (left_h + penalty) + (g - left_g) ** 2 / (h - left_h + penalty) - whole
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (feature, float(cuts[k]))
    return found


def threshold(scores: np.ndarray, labels: np.ndarray, precision: float) -> float:
    """The least score at and above which held-out labels are right in the wanted share; infinity if there is none.

    The share counts one error more than seen, so that a few rows alone give no threshold.
    """
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(labels[order].astype(float))
    share = right / (np.arange(len(order)) + 2)
    last = np.append(scores[order][1:] != scores[order][:-1], True) if len(order) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else np.inf
