"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

A text is the set of its hashed n-grams: one to three words' shapes (case, digits, punctuation, repeated or not) and one
or two words. Indicators are scaled by the class log-count ratio, a linear hinge-loss model is fitted to them by dual
coordinate descent, and its margin is mapped to a probability by a logistic curve fitted to margins of texts that the
model did not see.

Null and empty texts have no n-gram and get the score of the bias. Repeated rows are scored each. Without labels of both
classes every score is a half (nothing is rejected). An empty table gives an empty result. Columns other than doc_id and
text are not read. The fit uses at most PER_CLASS labelled texts of each class and 16 MB of them; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import _SPACE, _WORD, U64, append_scores, kept_by_score, labelled_sample, lowered, mix, run_hashes, runs, sigmoid, text_buffer

#: Bound of the labelled sample, for each class.
PER_CLASS = 3000
DIM, LEAST_TEXTS, SMOOTH, COST, EPOCHS = 1 << 18, 3, 1.0, 0.1, 12


def ngram_features(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text."""
    n = len(offsets) - 1
    inside = ~_SPACE[raw]
    starts, bounds = runs(inside, offsets)
    if not len(starts):
        return [np.zeros(0, np.int32)] * n
    low, at = lowered(raw), starts - starts[0]
    count = lambda mask: np.add.reduceat((mask & inside)[starts[0] :].astype(np.int32), at)
    word = _WORD[raw]
    upper, lower, digit = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), (raw >= 48) & (raw <= 57)
    words = run_hashes(low * (word & inside), starts)
    signs = np.add.reduceat(mix(np.where(word | ~inside, 0, raw).astype(U64))[starts[0] :], at)
    row_of = np.repeat(np.arange(n), np.diff(bounds))
    same = np.zeros(len(starts), bool)
    same[1:] = (words[1:] == words[:-1]) & (row_of[1:] == row_of[:-1])
    case = (count(upper) > 0) + 2 * (count(lower) > 0)
    shape = mix(signs + (case + 4 * (count(digit) > 0) + 8 * (count(word) == 0) + 16 * same).astype(U64) + U64(1))
    out = []
    marks = np.zeros(DIM, np.int32)
    grams = [(shape, 11), (words, 12)]
    for values, salt in ((shape, 13), (words, 14)):
        grams.append((mix(values[:-1] * U64(3) + values[1:]), salt))
    grams.append((mix(mix(shape[:-2] * U64(3) + shape[1:-1]) * U64(5) + shape[2:]) if len(shape) > 2 else shape[:0], 15))
    grams = [(mix(v ^ U64(salt * 0x9E3779B1)) % U64(DIM)).astype(np.int32) for v, salt in grams]
    spans = (1, 1, 2, 2, 3)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = np.concatenate([g[a : max(a, b - span + 1)] for g, span in zip(grams, spans, strict=True)])
        order = np.arange(len(own))
        marks[own] = order
        out.append(own[marks[own] == order])
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in features]) + self.bias

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(ngram_features(raw, offsets)) + self.shift)


def log_count_ratio(features: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.full(DIM, SMOOTH) for _ in (0, 1)]
    for f, label in zip(features, y, strict=True):
        counts[label][f] += 1
    seen = counts[0] + counts[1] - 2 * SMOOTH
    ratio = np.log(counts[1] / (SMOOTH * 2 + (y == 1).sum())) - np.log(counts[0] / (SMOOTH * 2 + (y == 0).sum()))
    return np.where(seen >= LEAST_TEXTS, ratio, 0)


def dual_coordinate_descent(features: list[np.ndarray], scale: np.ndarray, y: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights of indicators and bias of min |w|^2/2 + sum of costs times hinge losses; costs even out the classes."""
    rng, sign = np.random.default_rng(seed), np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, COST * len(y) / (2 * max(1, (y == 1).sum())), COST * len(y) / (2 * max(1, (y == 0).sum())))
    own = [f[scale[f] != 0] for f in features]
    size = [max(1.0, float(np.sqrt((scale[f] ** 2).sum()))) for f in own]
    values = [(scale[f] / s).astype(np.float32) for f, s in zip(own, size, strict=True)]
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(y))
    square = np.array([float(v @ v) + 1 for v in values])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            gradient = sign[i] * (w[own[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * sign[i]:
                alpha[i] = new
                w[own[i]] += step * values[i]
                bias += step
    return w * scale, bias


def _margin(features: list[np.ndarray], weights: np.ndarray, scale: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[f].sum() / max(1.0, float(np.sqrt((scale[f] ** 2).sum()))) for f in features]) + bias


@dataclass
class Fitted(Model):
    scale: np.ndarray

    def margins(self, features: list[np.ndarray]) -> np.ndarray:
        return _margin(features, self.weights, self.scale, self.bias)


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, classes weighted alike, by Newton's method."""
    a, b = 1.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    target = np.where(y == 1, 1 - 1e-3, 1e-3)
    for _ in range(60):
        p = sigmoid(a * margins + b)
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * margins).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-4, (h * margins).sum()], [(h * margins).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(0.1, a - step[0]), b - step[1]
    return float(a), float(b)


def fit(sample: list[tuple[str, int]]) -> Model:
    y = np.array([v for _, v in sample], dtype=np.int64)
    if len({*y.tolist()}) < 2:
        return Fitted(np.zeros(DIM), 0.0, 1.0, 0.0, np.zeros(DIM))
    features = [f for t, _ in sample for f in ngram_features(*text_buffer([t]))]
    fold, margins = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len({*y[rest].tolist()}) == 2:
            part = [features[i] for i in rest]
            scale = log_count_ratio(part, y[rest])
            w, bias = dual_coordinate_descent(part, scale, y[rest])
            margins[own] = _margin([features[i] for i in own], w, scale, bias)
    scale = log_count_ratio(features, y)
    w, bias = dual_coordinate_descent(features, scale, y)
    slope, shift = logistic_curve(margins, y)
    return Fitted(w.astype(np.float32), bias, slope, shift, scale.astype(np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) of every row of docs."""
    model = fit(labelled_sample(docs, labels, "quality", per_class))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_scores(docs, lambda raw, offsets: shared.value.score(raw, offsets), 0.3)


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that the classifier doesn't reject: no join, each row by its own text, null and repeated ids too."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, "quality", per_class)))
    return kept_by_score(docs, lambda raw, offsets: shared.value.score(raw, offsets), lambda s: s >= 0.3)
