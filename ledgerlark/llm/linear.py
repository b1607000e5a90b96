"""A linear hinge-loss model fitted by dual coordinate descent on sparse or dense rows."""

from __future__ import annotations

import numpy as np


def fit_hinge(
    rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, size: int, cost: np.ndarray, epochs: int = 20
) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised L1-loss support vector machine.

    rows: (indices, values) of each row; sign: +1 or -1; cost: the upper bound of each dual variable.
    """
    weight, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for _, v in rows])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        change = 0.0
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            gradient = sign[i] * (weight[index] @ value + weight[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[index] += step * value
                weight[-1] += step
                alpha[i] = new
                change = max(change, abs(gradient))
        if change < 1e-3:
            break
    return weight


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve that maps margins to probabilities."""
    a, b = 1.0, 0.0
    rate = (label.sum() + 1.0) / (label.sum() + 2.0), 1.0 / (len(label) - label.sum() + 2.0)
    target = np.where(label == 1, rate[0], rate[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(p - target) @ margin, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[s @ margin**2 + 1e-3, s @ margin], [s @ margin, s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def probability(margin: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(a * np.asarray(margin) + b, -30.0, 30.0)))


def fit_rising(rows: np.ndarray, label: np.ndarray, rising: int) -> np.ndarray:
    """``fit_logistic`` with no negative weight among the first ``rising``: such columns are left out in turn."""
    used = list(range(rows.shape[1]))
    while True:
        w = fit_logistic(rows[:, used], label)
        low = min((w[i], i) for i, c in enumerate(used) if c < rising) if used[0] < rising else (0.0, 0)
        if low[0] >= 0:
            break
        del used[low[1]]
    whole = np.zeros(rows.shape[1] + 1)
    whole[used], whole[-1] = w[:-1], w[-1]
    return whole


def fit_logistic(rows: np.ndarray, label: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the bias) of the ridge logistic regression of dense rows, by Newton's method."""
    x = np.column_stack([rows, np.ones(len(rows))])
    weight, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = probability(x @ weight, 1.0, 0.0)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (p - label) + penalty * weight)
        weight -= step
        if np.abs(step).max() < 1e-6:
            break
    return weight
