"""A small linear-chain conditional random field: training by gradient ascent, decoding in batches."""

from __future__ import annotations

import numpy as np


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class ChainCRF:
    """Labels a sequence of feature sets. ``weights`` are features x labels, ``moves`` label x label."""

    def __init__(self, labels: tuple[str, ...]) -> None:
        self.labels = labels
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(labels)))
        self.moves = np.zeros((len(labels), len(labels)))

    def emission(self, features: list[str]) -> np.ndarray:
        known = [i for f in features if (i := self.index.get(f)) is not None]
        return self.weights[known].sum(axis=0) if known else np.zeros(len(self.labels))

    def fit(self, sequences: list[list[tuple[list[str], str]]], rounds: int = 300, rate: float = 0.1, penalty: float = 0.0005, lexical: float = 12.0) -> ChainCRF:
        """Maximises the penalised likelihood; sequences of one length are handled together.

        Features that name words (``w:`` and ``p:``) are penalised ``lexical`` times as much,
        so that endings, overlap and language decide where they speak clearly.
        """
        for sequence in sequences:
            for features, _ in sequence:
                for f in features:
                    self.index.setdefault(f, len(self.index))
        k = len(self.labels)
        self.weights = np.zeros((len(self.index), k))
        toll = np.array([lexical if f[:2] in ("w:", "p:") else 1.0 for f in self.index])[:, None] * penalty * len(sequences)
        by_length: dict[int, list] = {}
        for sequence in sequences:
            by_length.setdefault(len(sequence), []).append(sequence)
        batches = []
        for length, group in sorted(by_length.items()):
            rows, cols, gold = [], [], np.zeros((len(group), length), dtype=int)
            for b, sequence in enumerate(group):
                for t, (features, label) in enumerate(sequence):
                    gold[b, t] = self.labels.index(label)
                    for f in set(features):
                        rows.append(b * length + t)
                        cols.append(self.index[f])
            batches.append((length, len(group), np.array(rows), np.array(cols), gold))
        params = [self.weights, self.moves]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            grads = [-toll * self.weights, -penalty * len(sequences) * self.moves]
            for length, size, rows, cols, gold in batches:
                score = np.stack([np.bincount(rows, self.weights[cols, j], size * length) for j in range(k)], axis=1)
                score = score.reshape(size, length, k)
                node, edge = self._marginals(score)
                target = np.eye(k)[gold]
                difference = (target - node).reshape(size * length, k)
                for j in range(k):
                    grads[0][:, j] += np.bincount(cols, difference[rows, j], len(self.index))
                if length > 1:
                    grads[1] += np.einsum("bti,btj->ij", target[:, :-1], target[:, 1:]) - edge
            for param, grad, m, v in zip(params, grads, first, second):  # adaptive moments
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, length, k = score.shape
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, length):
            ahead[:, t] = score[:, t] + _log_sum(ahead[:, t - 1, :, None] + self.moves, 1)
        for t in range(length - 2, -1, -1):
            back[:, t] = _log_sum(self.moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        whole = _log_sum(ahead[:, -1], 1)
        node = np.exp(ahead + back - whole[:, None, None])
        edge = np.zeros((k, k))
        for t in range(length - 1):
            edge += np.exp(ahead[:, t, :, None] + self.moves + (score[:, t + 1] + back[:, t + 1])[:, None, :] - whole[:, None, None]).sum(axis=0)
        return node, edge

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best label numbers of each sequence of emissions (arrays length x labels); sequences of one length go together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(emissions)
        by_length: dict[int, list[int]] = {}
        for i, e in enumerate(emissions):
            by_length.setdefault(len(e), []).append(i)
        for length, who in by_length.items():
            if not length:
                continue
            score = np.stack([emissions[i] for i in who])
            best, back = score[:, 0], []
            for t in range(1, length):
                step = best[:, :, None] + self.moves
                back.append(step.argmax(axis=1))
                best = step.max(axis=1) + score[:, t]
            path = [best.argmax(axis=1)]
            for pointers in reversed(back):
                path.append(pointers[np.arange(len(who)), path[-1]])
            labels = np.stack(path[::-1], axis=1)
            for i, row in zip(who, labels):
                out[i] = row
        return out
