"""Gradient boosting of small trees for binary labels, and its trees as SQL expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[str, float, "Tree", "Tree"]  # a leaf, or (feature, limit, at or below it, above it)


@dataclass
class Booster:
    """Logistic boosting with Newton leaves. fit() takes rows as dicts of numbers; it is for a bounded training set."""

    rounds: int = 30
    depth: int = 2
    rate: float = 0.3
    trees: list[Tree] = field(default_factory=list)
    bias: float = 0.0
    threshold: float = 0.5

    def fit(self, rows: list[dict[str, float]], labels: list[int]) -> Booster:
        names = list(rows[0])
        x, y = np.array([[r[n] for n in names] for r in rows], float), np.array(labels, float)
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.bias, self.trees = math.log(share / (1 - share)), []
        scores = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-scores))
            self.trees.append(self._grow(names, x, y - p, p * (1 - p), np.arange(len(y)), self.depth, scores))
        return self

    def _grow(self, names: list[str], x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int, scores: np.ndarray) -> Tree:
        """A tree over the rows at; scores take its leaves."""
        total_g, total_h = g[at].sum(), h[at].sum()
        best, gain = None, 1e-9
        for k in range(len(names)) if depth else ():
            order = at[np.argsort(x[at, k], kind="stable")]
            value = x[order, k]
            cut = np.flatnonzero(value[1:] > value[:-1])
            if not len(cut):
                continue
            left_g, left_h = np.cumsum(g[order])[cut], np.cumsum(h[order])[cut]
            gains = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            i = int(np.argmax(gains))
            if gains[i] > gain:
                best, gain = (k, float((value[cut[i]] + value[cut[i] + 1]) / 2)), float(gains[i])
        if best is None:
            leaf = float(self.rate * total_g / (total_h + 1))
            scores[at] += leaf
            return leaf
        k, limit = best
        low = x[at, k] <= limit
        return names[k], limit, self._grow(names, x, g, h, at[low], depth - 1, scores), self._grow(names, x, g, h, at[~low], depth - 1, scores)

    def _leaf(self, tree: Tree, row: dict[str, float]) -> float:
        while not isinstance(tree, float):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row: dict[str, float]) -> float:
        return 1 / (1 + math.exp(-self.bias - sum(self._leaf(t, row) for t in self.trees)))

    def calibrate(self, rows: list[dict[str, float]], labels: list[int], precision: float = 0.95) -> Booster:
        """The least threshold at which held-out rows reach the precision."""
        ranked = sorted(zip((self.score(r) for r in rows), labels, strict=True), reverse=True)
        hits = 0
        self.threshold = 1.0
        for n, (score, label) in enumerate(ranked, 1):
            hits += label
            if hits / n >= precision and (n == len(ranked) or ranked[n][0] < score):
                self.threshold = score
        return self

    def column(self, features: dict[str, Column]) -> Column:
        """The score as a SQL expression over the features' columns."""

        def of(tree: Tree) -> Column:
            return F.lit(tree) if isinstance(tree, float) else F.when(features[tree[0]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))
