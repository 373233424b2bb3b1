"""FTRL-proximal logistic regression: per-coordinate learning rates and L1 sparsity."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """One pass at a time over (index array, value array or 1, label in 0..1, importance)."""

    def __init__(self, size: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 1.5, l2: float = 0.5):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, value: np.ndarray | float, label: float, weight: float = 1.0) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(np.sum(w * value), -35, 35)))
        g = weight * (p - label) * value
        g = np.broadcast_to(g, w.shape)
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown
        return float(p)
