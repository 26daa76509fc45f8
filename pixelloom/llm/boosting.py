"""A small gradient-boosted tree classifier (logistic loss, histogram splits).

It is fitted on the driver, on a bounded sample of labelled rows, and scored either
with numpy (``GBT.margin``) or as a plain column expression (``GBT.column``), so that a
DataFrame-only operator can use it without Python on the executors.  Training is
deterministic: fixed order, no row sampling.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 32


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    value: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None

    def apply(self, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        if self.left is None:
            out[rows] += self.value
            return
        go = x[rows, self.feature] <= self.cut
        self.left.apply(x, out, rows[go])
        self.right.apply(x, out, rows[~go])

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(features[self.feature] <= F.lit(self.cut), self.left.column(features)).otherwise(self.right.column(features))


@dataclass
class GBT:
    trees: int = 20
    depth: int = 3
    rate: float = 0.3
    l2: float = 1.0
    min_rows: int = 5
    start: float = 0.0
    nodes: list[Node] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "GBT":
        """``x``: rows by features, ``y``: 0 or 1."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start, self.nodes = float(np.log(p / (1 - p))), []
        if not len(y) or y.min() == y.max():
            return self
        cuts = [self._cuts(x[:, j]) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, cuts, q - y, q * (1 - q), np.arange(len(y)), self.depth)
            tree.apply(x, margin, np.arange(len(y)))
            self.nodes.append(tree)
        return self

    @staticmethod
    def _cuts(v: np.ndarray) -> np.ndarray:
        u = np.unique(v)
        if len(u) > BINS:
            u = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1), method="lower"))
        return (u[:-1] + u[1:]) / 2

    def _grow(self, binned, cuts, g, h, rows, depth) -> Node:
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = Node(value=float(-self.rate * gs / (hs + self.l2)))
        if depth == 0 or len(rows) < 2 * self.min_rows:
            return leaf
        best, gain = None, 1e-6
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            score = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
            score[(nl < self.min_rows) | (len(rows) - nl < self.min_rows)] = -1
            k = int(np.argmax(score))
            if score[k] > gain:
                best, gain = (j, k), float(score[k])
        if best is None:
            return leaf
        j, k = best
        go = binned[rows, j] <= k
        return Node(j, float(cuts[j][k]), 0.0, self._grow(binned, cuts, g, h, rows[go], depth - 1), self._grow(binned, cuts, g, h, rows[~go], depth - 1))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.nodes:
            tree.apply(np.asarray(x, float), out, np.arange(len(x)))
        return out

    def column(self, features: list[Column]) -> Column:
        """The margin as an expression over double columns."""
        out = F.lit(self.start)
        for tree in self.nodes:
            out = out + tree.column(features)
        return out


def calibrated_threshold(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin from which held-out rows reach ``precision`` (infinite if none)."""
    order = np.argsort(-margin, kind="stable")
    m, hit = margin[order], np.cumsum(y[order])
    ok = hit / np.arange(1, len(m) + 1) >= precision if len(m) else np.zeros(0, bool)
    last = np.append(m[1:] != m[:-1], True) if len(m) else ok  # whole ties only
    good = np.flatnonzero(ok & last)
    return float(m[good[-1]]) if len(good) else float("inf")


def halves(keys: np.ndarray) -> np.ndarray:
    """True for the rows to train on; by key, so that it does not depend on order."""
    return (np.asarray(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(3) != 0
