"""Small gradient-boosted trees in numpy, for bounded training samples; scoring is vectorised and runs inside tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Binary log-loss boosting of depth-two trees over quantile cuts."""

    rounds: int = 40
    rate: float = 0.3
    bins: int = 16
    trees: list[tuple] = field(default_factory=list)
    base: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n = len(y)
        p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if n == 0:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            root = self._best(x, g, h, cuts, np.ones(n, bool))
            if root is None:
                break
            j, c = root
            left = x[:, j] <= c
            sides = []
            for side in (left, ~left):
                split = self._best(x, g, h, cuts, side)
                if split is None:
                    v = self._leaf(g, h, side)
                    sides.append((j, c, v, v))
                else:
                    k, d = split
                    low = x[:, k] <= d
                    sides.append((k, d, self._leaf(g, h, side & low), self._leaf(g, h, side & ~low)))
            self.trees.append((j, c, *sides))
            score += self._tree(x, self.trees[-1])
        return self

    def _leaf(self, g: np.ndarray, h: np.ndarray, where: np.ndarray) -> float:
        return self.rate * float(g[where].sum() / (h[where].sum() + 1.0))

    def _best(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], where: np.ndarray) -> tuple[int, float] | None:
        gs, hs = g[where], h[where]
        total_g, total_h = gs.sum(), hs.sum()
        best, found = total_g**2 / (total_h + 1.0) + 1e-6, None
        for j, points in enumerate(cuts):
            if not len(points):
                continue
            at = np.searchsorted(points, x[where, j], side="left")
            left_g = np.cumsum(np.bincount(at, gs, len(points) + 1))[:-1]
            left_h = np.cumsum(np.bincount(at, hs, len(points) + 1))[:-1]
            gain = left_g**2 / (left_h + 1.0) + (total_g - left_g) ** 2 / (total_h - left_h + 1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (j, float(points[k]))
        return found

    @staticmethod
    def _tree(x: np.ndarray, tree: tuple) -> np.ndarray:
        j, c, low, high = tree
        a = np.where(x[:, low[0]] <= low[1], low[2], low[3])
        b = np.where(x[:, high[0]] <= high[1], high[2], high[3])
        return np.where(x[:, j] <= c, a, b)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._tree(x, tree)
        return 1 / (1 + np.exp(-score))
