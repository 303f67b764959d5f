"""Logistic calibration of a few features, and labels' natural weights."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a sample the class shares of all labelled rows; they sum to the sample's size."""
    total = sum(counts.get(k, 0) for k in (0, 1)) or 1
    w = np.ones(len(y))
    for k in (0, 1):
        if (y == k).any():
            w[y == k] = counts.get(k, 0) / total * len(y) / (y == k).sum()
    return w


class Logistic:
    """P(1) as a logistic function of standardised features, fitted by Newton steps with an L2 penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        ridge = np.diag([penalty] * x.shape[1] + [1e-6])
        self.beta = np.zeros(z.shape[1])
        loss = np.inf
        for _ in range(50):
            p = sigmoid(z @ self.beta)
            now = -(w * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum() + self.beta @ ridge @ self.beta / 2
            step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ self.beta)
            if loss - now < 1e-7 and np.abs(step).max() < 1e-4:
                break
            loss = now
            self.beta += np.clip(step, -2, 2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.mean) / self.scale) @ self.beta[:-1] + self.beta[-1])
