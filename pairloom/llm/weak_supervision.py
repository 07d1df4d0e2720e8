"""From votes of labelers to a classifier: reliabilities by expectation and maximisation, then a logistic model.

Everything here works on bounded summaries that Spark made: counts of vote patterns, and a bounded sample of candidates.
"""

from __future__ import annotations

import numpy as np

VOTES = (-1, 0, 1)
#: Prior observations of every labeler: how often it votes -1, 0, 1 on a false and on a true candidate.
PRIOR = np.array([[8.0, 9.0, 3.0], [3.0, 9.0, 8.0]])
#: Prior candidates of every kind: false and true.
PRIOR_KIND = np.array([6.0, 4.0])


class Reliabilities:
    """P(vote of labeler | truth), shared by all kinds, and P(truth) of each kind, from counts of (kind, votes)."""

    def __init__(self, kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, n_kinds: int, n_labelers: int, rounds: int = 200, tolerance: float = 1e-10):
        self.votes = np.broadcast_to(PRIOR / PRIOR.sum(axis=1, keepdims=True), (n_labelers, 2, 3)).copy()
        self.kinds = np.broadcast_to(PRIOR_KIND / PRIOR_KIND.sum(), (n_kinds, 2)).copy()
        self.rounds = 0
        for self.rounds in range(1, rounds + 1):
            share = self.truth(kinds, votes)
            weight = np.stack([1 - share, share], axis=1) * counts[:, None]
            seen = np.stack([[weight[votes[:, l] == v].sum(axis=0) for v in VOTES] for l in range(n_labelers)]) + PRIOR.T  # noqa: E741
            own = np.stack([weight[kinds == k].sum(axis=0) for k in range(n_kinds)]) + PRIOR_KIND
            new_votes, new_kinds = (seen / seen.sum(axis=1, keepdims=True)).transpose(0, 2, 1), own / own.sum(axis=1, keepdims=True)
            moved = max(np.abs(new_votes - self.votes).max(), np.abs(new_kinds - self.kinds).max())
            self.votes, self.kinds = new_votes, new_kinds
            if moved < tolerance:
                break

    def truth(self, kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """P(true | votes) of each row."""
        log = np.log(self.kinds)[kinds]
        for l in range(votes.shape[1]):  # noqa: E741
            log = log + np.log(self.votes)[l][:, votes[:, l] + 1].T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def logistic(features: np.ndarray, truth: np.ndarray, size: int, bias: float = -2.0, decay: float = 1e-4, steps: int = 300, rate: float = 0.5) -> np.ndarray:
    """Weights for hashed features (rows of equally many, 0 is none) that give the truths; the last weight is the bias.

    The bias stays as it is: what was never seen is taken for false.
    """
    w, spread = np.zeros(size + 1), np.full(size + 1, 1e-8)
    w[size] = bias
    n, width = features.shape
    flat = features.ravel()
    for _ in range(steps if n else 0):
        error = predicted(w, features) - truth
        g = np.append(np.bincount(flat, weights=np.repeat(error, width), minlength=size), error.sum()) / n + decay * w
        g[0] = g[size] = 0.0
        spread += g * g
        w -= rate * g / np.sqrt(spread)
    return w


def predicted(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    score = w[features].sum(axis=1) + w[-1] if len(features) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))
