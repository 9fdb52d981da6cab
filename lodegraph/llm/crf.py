"""A linear-chain conditional random field in numpy: training, batched Viterbi, and forward-backward marginals.

Sequences lie one after another in flat arrays; `sizes` gives their lengths. Batches run time step by time step over
the sequences that are still that long, longest first, so no padding is computed. Empty sequences are allowed.
"""

from __future__ import annotations

import numpy as np


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the sequences, longest first, and for each time step how many are still running."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    running = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
    return starts[order], running


class Crf:
    """emission: one weight for each feature and label; moves: from label to label; first: of a sequence's first label."""

    def __init__(self, emission: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.emission, self.moves, self.first = emission, moves, first

    def scores(self, features: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Emission scores of items whose feature numbers are features[ends[k]:ends[k + 1]]."""
        total = np.concatenate([np.zeros((1, self.emission.shape[1])), np.cumsum(self.emission[features], axis=0)])
        return total[ends[1:]] - total[ends[:-1]]

    def viterbi(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best label of each position."""
        starts, running = _steps(sizes)
        back = np.zeros(scores.shape, np.int16)
        best = np.zeros((len(starts), scores.shape[1]))
        out = np.zeros(len(scores), np.int16)
        for t, n in enumerate(running):
            at = starts[:n] + t
            if t == 0:
                best[:n] = self.first + scores[at]
            else:
                paths = best[:n, :, None] + self.moves
                back[at] = paths.argmax(1)
                best[:n] = paths.max(1) + scores[at]
        for t in range(len(running) - 1, -1, -1):
            n, longer = running[t], running[t + 1] if t + 1 < len(running) else 0
            at = starts[:n] + t
            if longer:
                out[at[:longer]] = back[at[:longer] + 1, out[at[:longer] + 1]]
            out[at[longer:]] = best[longer:n].argmax(1)
        return out

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Label probabilities of each position, expected moves, expected first labels, and the sum of the log partition functions."""
        starts, running = _steps(sizes)
        top = scores.max(1, keepdims=True) if len(scores) else scores[:, :1]
        local, moves, first = np.exp(scores - top), np.exp(self.moves), np.exp(self.first)
        forward, scale = np.zeros(scores.shape), np.ones(len(scores))
        for t, n in enumerate(running):
            at = starts[:n] + t
            f = (forward[at - 1] @ moves if t else first) * local[at]
            s = f.sum(1)
            forward[at], scale[at] = f / s[:, None], s
        backward = np.ones(scores.shape)
        expected = np.zeros(self.moves.shape)
        for t in range(len(running) - 2, -1, -1):
            at = starts[: running[t + 1]] + t
            ahead = backward[at + 1] * local[at + 1] / scale[at + 1, None]
            backward[at] = ahead @ moves.T
            expected += forward[at].T @ ahead * moves
        p = forward * backward
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        heads = starts[: running[0]] if len(running) else starts[:0]
        return p, expected, p[heads].sum(0), float(np.log(scale).sum() + top.sum())


def train(features: np.ndarray, ends: np.ndarray, kinds: np.ndarray, labels: np.ndarray, sizes: np.ndarray, n_features: int, n_labels: int, weight: np.ndarray | None = None, steps: int = 60, rate: float = 0.25, l2: float = 0.02) -> Crf:
    """Maximum likelihood by full-batch Adam. kinds: for each position the number of its item, whose features are given.

    Starts from zero weights and uses no chance, so equal inputs give equal models. l2 is the penalty, against the whole sum.
    """
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    model = Crf(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    item = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    n_items = len(ends) - 1
    gold = np.bincount(kinds * n_labels + labels, minlength=n_items * n_labels).reshape(n_items, n_labels).astype(float)
    inner = np.ones(len(labels), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    gold_moves = np.bincount(labels[at - 1] * n_labels + labels[at], minlength=n_labels**2).reshape(n_labels, n_labels).astype(float)
    gold_first = np.bincount(labels[starts], minlength=n_labels).astype(float)
    params = [model.emission, model.moves, model.first]
    means, squares = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    scale = max(1, len(labels))
    for step in range(1, steps + 1):
        p, moves, first, _ = model.marginals(model.scores(features, ends)[kinds], sizes)
        seen = np.stack([np.bincount(kinds, p[:, k], n_items) for k in range(n_labels)], 1)
        gap = (gold - seen)[item]
        emission = np.stack([np.bincount(features, gap[:, k], n_features) for k in range(n_labels)], 1)
        for k, g in enumerate((emission, gold_moves - moves, gold_first - first)):
            g = (g - l2 * params[k]) / scale
            means[k] = 0.9 * means[k] + 0.1 * g
            squares[k] = 0.99 * squares[k] + 0.01 * g * g
            params[k] += rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-9)
    return model
