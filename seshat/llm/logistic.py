"""Small sparse models fitted on the driver from bounded training tables."""

from __future__ import annotations

import numpy as np


def fit_logistic(rows: list[list[int]], classes: np.ndarray, width: int, n_classes: int, *, l2: float = 1e-3, rate: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on rows of feature numbers below ``width`` (repeats add up).

    Full-batch gradient steps with Adagrad from zero: the same rows give the same model. Returns weights
    (width x n_classes) and intercepts.
    """
    index = np.array([i for r in rows for i in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(rows))))
    weights, bias = np.zeros((width, n_classes)), np.zeros(n_classes)
    seen_w, seen_b = np.full(weights.shape, 1e-8), np.full(n_classes, 1e-8)
    target = np.eye(n_classes)[classes]
    for _ in range(rounds):
        score = np.zeros((len(rows), n_classes))
        np.add.at(score, owner, weights[index] * scale[owner, None])
        score += bias
        p = np.exp(score - score.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) / len(rows)
        grad = np.zeros_like(weights)
        np.add.at(grad, index, error[owner] * scale[owner, None])
        grad += l2 * weights
        seen_w += grad**2
        seen_b += error.sum(0) ** 2
        weights -= rate * grad / np.sqrt(seen_w)
        bias -= rate * error.sum(0) / np.sqrt(seen_b)
    return weights, bias
