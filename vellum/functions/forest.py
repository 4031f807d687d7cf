"""A small calibrated forest of randomised trees in NumPy.

Fitted on the driver from a bounded sample, sent to the executors as arrays and
evaluated there over Arrow batches without a loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as parallel arrays: feature < 0 marks a leaf."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    child: list[np.ndarray]
    leaf: list[np.ndarray]
    classes: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(self.classes)))
        if not len(x):
            return total
        rows = np.arange(len(x))
        for feature, threshold, child, leaf in zip(self.feature, self.threshold, self.child, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.where(inner, f, 0)] > threshold[node]
                node = np.where(inner, child[node] + right, node)
            total += leaf[node]
        return total / len(self.feature)

    def confidence(self, top: np.ndarray) -> np.ndarray:
        """Share of right answers that held-out rows showed at such a top probability."""
        edges, level = self.steps
        return level[np.clip(np.searchsorted(edges, top, side="right") - 1, 0, len(level) - 1)]


def isotonic(score: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: edges and the rising shares of right answers from each edge on."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, r in zip(score[order], right[order], strict=True):
        blocks.append([s, float(r), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return np.array([b[0] for b in blocks] or [0.0]), np.array([b[1] / b[2] for b in blocks] or [0.0])


def _grow(x: np.ndarray, y: np.ndarray, k: int, rng: np.random.Generator, depth: int, least: int, tries: int) -> tuple[np.ndarray, ...]:
    feature, threshold, child, leaf = [-1], [0.0], [0], [np.bincount(y, minlength=k)]
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        node, rows, level = todo.pop()
        counts = leaf[node]
        if level >= depth or len(rows) < 2 * least or counts.max() == len(rows):
            continue
        best = None
        for f in rng.choice(x.shape[1], size=min(tries, x.shape[1]), replace=False):
            v = x[rows, f]
            low, high = v.min(), v.max()
            if low == high:
                continue
            cut = rng.uniform(low, high)
            right = v > cut
            n = int(right.sum())
            if n < least or len(rows) - n < least:
                continue
            c = np.bincount(y[rows[right]], minlength=k)
            gain = (c.astype(float) ** 2).sum() / n + ((counts - c).astype(float) ** 2).sum() / (len(rows) - n)
            if best is None or gain > best[0]:
                best = (gain, f, cut, right, c)
        if best is None:
            continue
        _, f, cut, right, c = best
        feature[node], threshold[node], child[node] = int(f), float(cut), len(feature)
        for part, count in ((rows[~right], counts - c), (rows[right], c)):
            todo.append((len(feature), part, level + 1))
            feature.append(-1)
            threshold.append(0.0)
            child.append(0)
            leaf.append(count)
    share = np.array(leaf, dtype=float)
    return np.array(feature), np.array(threshold), np.array(child), share / np.maximum(share.sum(axis=1, keepdims=True), 1)


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 16, depth: int = 14, least: int = 3, tries: int = 16, held_out: float = 0.25, seed: int = 7) -> Forest:
    """Fit trees on a share of the rows and calibrate the top probability on the others.

    x: one row a record, numbers only.  y: class labels.  Without rows the forest has
    one class, None, and confidence 0.
    """
    if not len(y):
        return Forest([np.array([-1])], [np.array([0.0])], [np.array([0])], [np.ones((1, 1))], np.array([None], dtype=object), (np.array([0.0]), np.array([0.0])))
    rng = np.random.default_rng(seed)
    classes, codes = np.unique(y, return_inverse=True)
    held = rng.random(len(y)) < held_out
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    grown = [_grow(x[train], codes[train], len(classes), rng, depth, least, tries) for _ in range(trees)]
    forest = Forest(*(list(part) for part in zip(*grown, strict=True)), classes, (np.array([0.0]), np.array([0.0])))
    if held.any():
        p = forest.probabilities(x[held])
        forest.steps = isotonic(p.max(axis=1), p.argmax(axis=1) == codes[held])
    return forest
