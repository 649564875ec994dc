"""Quality classifier: naive Bayes support vectors.

Each n-gram indicator is scaled by its log-count ratio between the classes; a linear hinge-loss model on the scaled,
length-normalised indicators is fitted by dual coordinate descent, and its weights are averaged with those of naive
Bayes. Margins of a part kept from the fit give the slope and offset of the probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from helioframe.llm import features as X

GRAMS, THRESHOLD, PENALTY, EPOCHS, BLEND, SAMPLE_ROWS = (2, 3, 5), 0.3, 1.0, 12, 0.5, 4000


def _features(text: bytes) -> list[np.ndarray]:
    return [X.indicators(text, GRAMS, pairs=True)]


def log_count_ratio(rows: list[tuple[int, np.ndarray]], dim: int, alpha: float = 1.0) -> np.ndarray:
    count = np.full((2, dim), alpha)
    for y, f in rows:
        count[y][f] += 1
    count /= count.sum(axis=1, keepdims=True)
    return np.log(count[1] / count[0])


def dual_descent(rows: list[tuple[int, np.ndarray]], scale: np.ndarray, c: float = PENALTY, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and offset of the hinge-loss model min |w|^2 / 2 + sum c_i max(0, 1 - y w.x), one dual variable at a time.

    x is scale / sqrt(n) over a document's n features, and a constant 1. The rarer class weighs more, so that both
    weigh alike in sum.
    """
    up = sum(y for y, _ in rows)
    weigh = {1: c * len(rows) / (2 * max(1, up)), 0: c * len(rows) / (2 * max(1, len(rows) - up))}
    w, offset, alpha, rng = np.zeros_like(scale), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    small = scale.astype(np.float32)
    xs = [small[f] / np.float32(np.sqrt(max(1, len(f)))) for _, f in rows]
    norm = [float(x @ x) + 1 for x in xs]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            y, f = rows[i]
            s, x = (1.0 if y else -1.0), xs[i]
            gradient = s * (float(w[f] @ x) + offset) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), weigh[y])
            step = (new - alpha[i]) * s
            if step:
                w[f] += step * x
                offset += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, offset


def fit(rows: list[tuple[int, list[np.ndarray]]], dim: int = 1 << X.DIM_BITS) -> tuple[np.ndarray, float, float, float]:
    """(weights by feature, offset, slope, shift): the margin is offset + sum(weights) / sqrt(n).

    With one class or no rows every score is that class's share (0.5 without rows).
    """
    flat = [(y, x[0]) for y, x in rows]
    up = sum(y for y, _ in flat)
    if up in (0, len(flat)):
        return np.zeros(dim), 0.0, 0.0, float(np.log((up + 1) / (len(flat) - up + 1)))
    train, kept = [r for i, r in enumerate(flat) if i % 5], flat[::5]

    def model(rows):
        ratio = log_count_ratio(rows, dim)
        w, offset = dual_descent(rows, ratio)
        mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
        return ratio * ((1 - BLEND) * mean + BLEND * w), BLEND * offset

    v, offset = model(train if 0 < sum(y for y, _ in train) < len(train) else flat)
    margin = np.array([offset + v[f].sum() / np.sqrt(max(1, len(f))) for _, f in kept])
    return v, offset, *X.logistic(margin, np.array([y for y, _ in kept]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text): score is the probability of quality 1.

    Null texts are scored as empty ones. Repeated rows are scored alike. Without labels all scores are 0.5.
    """
    v, offset, a, b = fit(X.sample(docs, labels, "quality", _features, SAMPLE_ROWS))
    v = v.astype(np.float32)

    def run(text: bytes) -> float:
        f = X.indicators(text, GRAMS, pairs=True)
        return float(1 / (1 + np.exp(-np.clip(a * (offset + float(v[f].sum()) / np.sqrt(max(1, len(f)))) + b, -30, 30))))

    return X.score(docs, run, threshold)
