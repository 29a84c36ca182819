"""A linear-chain conditional random field with two labels over blocks of yes/no features.

A chain's score adds, for each block labelled 1, the weights of its features, and for each step a weight by the two labels
and by whether the two blocks are siblings.  Training maximises the likelihood of labelled chains (forward-backward,
resilient steps over the whole set); decoding is Viterbi's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

Chain = Sequence[tuple[int, bool]]   # (features as bits, sibling of the block before)


@dataclass
class Model:
    weights: list[float]
    steps: list[list[list[float]]]   # [sibling][label before][label]
    known: dict[int, float] = field(default_factory=dict)

    LIMIT = 100_000

    def score(self, features: int) -> float:
        found = self.known.get(features)
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            found = self.known[features] = sum(w for i, w in enumerate(self.weights) if features >> i & 1)
        return found

    def decode(self, chain: Chain) -> list[int]:
        """The labels of the best path; of equal paths the one with more zeros at its end."""
        back: list[tuple[int, int]] = []
        zero = one = 0.0
        for i, (features, sibling) in enumerate(chain):
            own = self.score(features)
            if not i:
                zero, one = 0.0, own
                continue
            (s00, s01), (s10, s11) = self.steps[sibling]
            from_zero, to_one = one + s10 > zero + s00, one + s11 > zero + s01
            back.append((int(from_zero), int(to_one)))
            zero, one = (one + s10 if from_zero else zero + s00), own + (one + s11 if to_one else zero + s01)
        if not chain:
            return []
        labels = [int(one > zero)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def _log_add(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(chains: Sequence[Chain], labels: Sequence[Sequence[int]], n_features: int, rounds: int = 60, ridge: float = 0.05) -> Model:
    """Weights for chains whose labels are known; empty chains teach nothing."""
    pairs = [(c, y) for c, y in zip(chains, labels, strict=True) if len(c)]
    kinds = {f: i for i, f in enumerate(sorted({f for c, _ in pairs for f, _ in c}))}
    have = np.array([[f >> i & 1 for i in range(n_features)] for f in kinds], float).reshape(len(kinds), n_features)
    n, longest = len(pairs), max((len(c) for c, _ in pairs), default=0)
    kind, sibling = np.zeros((n, longest), int), np.zeros((n, longest), int)
    truth, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for r, (c, y) in enumerate(pairs):
        kind[r, :len(c)] = [kinds[f] for f, _ in c]
        sibling[r, :len(c)] = [s for _, s in c]
        truth[r, :len(c)], real[r, :len(c)] = y, True
    seen_unary = np.bincount(kind[real], weights=truth[real], minlength=len(kinds)) @ have if n else np.zeros(n_features)
    step_real = real[:, 1:]
    seen_steps = np.zeros((2, 2, 2))
    np.add.at(seen_steps, (sibling[:, 1:][step_real], truth[:, :-1][step_real], truth[:, 1:][step_real]), 1)
    theta, size, before = np.zeros(n_features + 8), np.full(n_features + 8, 0.1), np.zeros(n_features + 8)
    for _ in range(rounds if n else 0):
        unary = np.zeros((n, longest, 2))
        unary[:, :, 1] = (have @ theta[:n_features])[kind]
        steps = theta[n_features:].reshape(2, 2, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            moved = _log_add(forward[:, t - 1, :, None] + steps[sibling[:, t]], 1) + unary[:, t]
            forward[:, t] = np.where(real[:, t, None], moved, forward[:, t - 1])
        total = _log_add(forward[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            moved = _log_add(steps[sibling[:, t + 1]] + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], moved, 0)
        p_one = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        p_step = np.exp(
            forward[:, :-1, :, None] + steps[sibling[:, 1:]] + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        expected_steps = np.zeros((2, 2, 2))
        for s in (0, 1):
            expected_steps[s] = p_step[step_real & (sibling[:, 1:] == s)].sum(axis=0)
        gradient = np.concatenate([
            seen_unary - np.bincount(kind[real], weights=p_one[real], minlength=len(kinds)) @ have, (seen_steps - expected_steps).ravel()])
        gradient -= ridge * theta
        turn = gradient * before
        size = np.clip(np.where(turn > 0, size * 1.2, np.where(turn < 0, size * 0.5, size)), 1e-6, 1.0)
        before = np.where(turn < 0, 0, gradient)
        theta += np.sign(before) * size
    return Model(theta[:n_features].tolist(), theta[n_features:].reshape(2, 2, 2).tolist())
