"""Logistic regression in numpy, for models that are fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Logistic:
    """Standardised features, an L2 penalty and Adam steps; the same data give the same weights."""

    def __init__(self, penalty: float = 1e-3, steps: int = 250, rate: float = 0.05):
        self.penalty, self.steps, self.rate = penalty, steps, rate

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1
        z = (x - self.mean) / self.scale
        z = np.clip(z, -8, 8)
        weight = np.ones(len(y)) if weight is None else weight
        weight = weight / weight.sum()
        w, b = np.zeros(x.shape[1]), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, self.steps + 1):
            error = (sigmoid(z @ w + b) - y) * weight
            g = np.append(z.T @ error + self.penalty * w, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w, b
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
