"""Isolation forest on one series of values (Liu, Ting and Zhou, ICDM 2008).

Runs inside a task, on the daily trend of one sensor: as many values as days. Samples and splits are drawn
from MD5 of the seed, the tree, the place and the sensor's name, so the same labels come out on any
partitioning, and in SQL.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

TREES = 100
SAMPLE = 256  # values a tree is grown on, as in the paper; all values are rated
CONTAMINATION = 0.1
SEED = 42
DIGITS = 9  # of a score; equal values get equal scores whatever the order of summing


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    more = np.maximum(n, 3.0)
    harmonic = np.log(more - 1.0) + np.euler_gamma
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2.0 * harmonic - 2.0 * (more - 1.0) / more))


def _digest(key: str) -> str:
    return hashlib.md5(key.encode(), usedforsecurity=False).hexdigest()


def _sample(values: np.ndarray, size: int, seed: str, tree: int, name: str) -> np.ndarray:
    """The values at the places with the least digests."""
    if size == len(values):
        return values
    keys = [_digest(f"{seed}:{tree}:s{place}:{name}") for place in range(len(values))]
    return values[np.argsort(keys, kind="stable")[:size]]


def _depths(sample: np.ndarray, points: np.ndarray, limit: int, seed: str, tree: int, name: str) -> np.ndarray:
    """Path length of every point in one random tree over the sample.

    Node k splits into 2k (values up to the cut, but not the largest) and 2k + 1; a level is one step for all values.
    """
    both = np.concatenate([sample, points])
    node = np.ones(len(both), np.int64)
    depth = np.zeros(len(both))
    n = len(sample)
    for _ in range(limit):
        nodes, place = np.unique(node, return_inverse=True)
        low, high = np.full(len(nodes), np.inf), np.full(len(nodes), -np.inf)
        np.minimum.at(low, place[:n], sample)
        np.maximum.at(high, place[:n], sample)
        splits = low < high
        if not splits.any():
            break
        draws = np.zeros(len(nodes))
        for k in np.flatnonzero(splits):
            draws[k] = int(_digest(f"{seed}:{tree}:n{nodes[k]}:{name}")[:8], 16) / 4294967296.0
        with np.errstate(invalid="ignore"):
            cut = low + draws * (high - low)
        left = (both <= cut[place]) & (both < high[place])
        moves = splits[place]
        node = np.where(moves, 2 * node + ~left, node)
        depth += moves
    sizes = dict(zip(*np.unique(node[:n], return_counts=True), strict=True))
    return depth[n:] + _mean_path([sizes.get(k, 0) for k in node[n:].tolist()])


def anomaly_scores(values: np.ndarray, name: str, *, seed: int = SEED, trees: int = TREES, sample: int = SAMPLE) -> np.ndarray:
    """Score of every value in (0, 1); the easier a value is isolated, the higher."""
    size = min(sample, len(values))
    limit = math.ceil(math.log2(max(size, 2)))
    total = np.zeros(len(values))
    for tree in range(trees):
        grown = _sample(values, size, str(seed), tree, name)
        total += _depths(grown, values, limit, str(seed), tree, name)
    return np.round(np.power(2.0, -total / trees / max(float(_mean_path(size)), 1.0)), DIGITS)


def is_anomaly(values: np.ndarray, name: str, contamination: float = CONTAMINATION, **how: int) -> np.ndarray:
    """Values whose negated score is strictly below the quantile of the contamination; values come in day order."""
    if len(values) == 0:
        return np.zeros(0, dtype=bool)
    normality = -anomaly_scores(values, name, **how)
    return normality < np.quantile(normality, contamination)
