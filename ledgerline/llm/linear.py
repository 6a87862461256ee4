"""Logistic regression on the driver, for bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights of the columns of ``x`` and last the intercept, by Newton steps.

    Without rows of both kinds the weights are 0 and the intercept is the smoothed log odds.
    """
    rows, columns = x.shape
    w = np.zeros(columns + 1)
    if rows == 0 or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (rows - y.sum() + 0.5))
        return w
    x = np.hstack((x, np.ones((rows, 1))))
    penalty = np.full(columns + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
