"""Linear-chain conditional random fields in numpy, vectorised over sequences.

Tokens carry up to K binary features as indexes from 1; 0 is none. Fitting takes a bounded sample; scoring runs inside Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Chain:
    """weights: features + 1 by labels, row 0 is the bias; moves: from by to; first: of the first token."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """features: sequences by tokens by K."""
        used = self.weights[features] * (features > 0)[..., None]
        return used.sum(axis=-2) + self.weights[0]

    def forward(self, e: np.ndarray) -> np.ndarray:
        a = np.empty_like(e)
        a[:, 0] = e[:, 0] + self.first
        for t in range(1, e.shape[1]):
            a[:, t] = _log_sum(a[:, t - 1, :, None] + self.moves, 1) + e[:, t]
        return a

    def backward(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        b = np.zeros_like(e)
        for t in range(e.shape[1] - 2, -1, -1):
            step = _log_sum(self.moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where((t + 1 < lengths)[:, None], step, 0.0)
        return b

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label chances of every token; rows beyond a sequence's length mean nothing."""
        x = self.forward(e) + self.backward(e, lengths)
        return np.exp(x - _log_sum(x, 2)[..., None])

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi labels of one sequence of emissions, tokens by labels."""
        best, back = e[0] + self.first, np.zeros(e.shape, dtype=np.int64)
        for t in range(1, len(e)):
            paths = best[:, None] + self.moves
            back[t] = paths.argmax(axis=0)
            best = paths.max(axis=0) + e[t]
        labels = np.empty(len(e), dtype=np.int64)
        labels[-1] = best.argmax()
        for t in range(len(e) - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels


def padded(sequences: list[list[list[int]]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature lists of tokens of sequences as one array, and the lengths."""
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    out = np.zeros((len(sequences), int(lengths.max(initial=1)), k), dtype=np.int32)
    for i, s in enumerate(sequences):
        for t, f in enumerate(s):
            out[i, t, : len(f)] = f[:k]
    return out, lengths


def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n_features: int, n_labels: int = 2, epochs: int = 12, batch: int = 256, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> Chain:
    """Maximum likelihood by Adam over mini-batches of padded sequences; deterministic."""
    rng = np.random.default_rng(seed)
    chain = Chain(np.zeros((n_features + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    slow = [(np.zeros_like(p), np.zeros_like(p)) for p in (chain.weights, chain.moves, chain.first)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(lengths))
        order = order[np.argsort(lengths[order] // 16, kind="stable")]  # batches of like length
        starts = rng.permutation(range(0, len(order), batch))
        for s in starts:
            rows = order[s : s + batch]
            n = lengths[rows]
            width = int(n.max())
            f, y = features[rows, :width], labels[rows, :width]
            inside = np.arange(width)[None, :] < n[:, None]
            e = chain.emissions(f)
            a, b = chain.forward(e), chain.backward(e, n)
            total = _log_sum(a[np.arange(len(rows)), n - 1], 1)
            p = np.exp(a + b - total[:, None, None]) * inside[..., None]
            gold = np.eye(n_labels)[y] * inside[..., None]
            miss = p - gold
            gw = np.zeros_like(chain.weights)
            for k in range(f.shape[2]):
                at = f[..., k].ravel()
                for c in range(n_labels):
                    gw[:, c] += np.bincount(at, weights=miss[..., c].ravel(), minlength=len(gw))
            gw[0] = miss.sum(axis=(0, 1))
            gm = np.zeros_like(chain.moves)
            if width > 1:
                both = np.exp(a[:, :-1, :, None] + chain.moves + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]) * inside[:, 1:, None, None]
                gm = both.sum(axis=(0, 1)) - np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
            gf = miss[:, 0].sum(axis=0)
            step += 1
            for p_, g, (m, v) in zip((chain.weights, chain.moves, chain.first), (gw, gm, gf), slow):
                g = g / len(rows) + l2 * p_
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return chain
