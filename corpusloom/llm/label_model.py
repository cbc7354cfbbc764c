"""A generative model of weak labels, and a sparse logistic scorer trained on what it infers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ABSTAIN, NEGATIVE, POSITIVE = 0, 1, 2


@dataclass
class LabelModel:
    """``rates[j, c, v]``: the chance that voter j casts v when the class is c; ``weight[j]`` discounts voters that repeat others."""

    prior: float
    rates: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of class 1 for each row of votes."""
        j = np.arange(votes.shape[1])
        gain = np.log(self.rates[j, 1, votes]) - np.log(self.rates[j, 0, votes])
        logit = np.log(self.prior / (1 - self.prior)) + gain @ self.weight
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """How often each voter is right when it doesn't abstain."""
        right = self.prior * self.rates[:, 1, POSITIVE] + (1 - self.prior) * self.rates[:, 0, NEGATIVE]
        cast = self.prior * self.rates[:, 1, 1:].sum(1) + (1 - self.prior) * self.rates[:, 0, 1:].sum(1)
        return right / np.maximum(cast, 1e-12)


def fit_label_model(votes: np.ndarray, count: np.ndarray, start: np.ndarray, correlated: bool = False, rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how often each occurs.

    ``start`` holds the first guess of each pattern's chance of class 1. With ``correlated``, what remains of the voters'
    correlation within the classes is estimated after each round, and a voter counts the less the more the others repeat it.
    """
    n, voters = votes.shape
    one_hot = (votes[:, :, None] == np.arange(3)).astype(float)
    weight = np.ones(voters)
    p = start.astype(float)
    model = None
    for _ in range(rounds):
        mass = np.stack((count * (1 - p), count * p))
        rates = np.einsum("cn,njv->jcv", mass, one_hot) + smooth / 3
        rates /= rates.sum(axis=2, keepdims=True)
        prior = float(np.clip(mass[1].sum() / max(count.sum(), 1e-12), 1e-4, 1 - 1e-4))
        if correlated and voters > 1:
            cov = np.zeros((voters, voters))
            for c in (0, 1):
                hit = one_hot[:, :, POSITIVE] - rates[:, c, POSITIVE]
                cov += (hit * mass[c][:, None]).T @ hit
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr = np.clip(cov / np.outer(sd, sd), 0, 1)
            weight = 1 / (1 + np.maximum(corr.sum(axis=1) - np.diag(corr) - 0.02 * voters, 0))
        model = LabelModel(prior, rates, weight)
        nxt = model.posterior(votes)
        done = np.abs(nxt - p).max(initial=0) < 1e-6
        p = nxt
        if done:
            break
    return model


@dataclass
class LinearScorer:
    weights: np.ndarray
    bias: float

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        z = self.bias + float(self.weights[idx] @ val) if len(idx) else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dims: int, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 400, rate: float = 0.2) -> LinearScorer:
    """Logistic regression on sparse rows ``(indices, values)`` with soft targets."""
    w, b = np.zeros(dims), 0.0
    if not rows:
        return LinearScorer(w, b)
    of = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    idx = np.concatenate([i for i, _ in rows]).astype(np.int64)
    val = np.concatenate([v for _, v in rows]).astype(float)
    share = np.ones(len(rows)) if weight is None else weight
    share = share / share.sum()
    mean = float(np.clip(share @ target, 1e-4, 1 - 1e-4))
    b = float(np.log(mean / (1 - mean)))
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(of, val * w[idx], len(rows))
        gap = share * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target)
        g, gb = np.bincount(idx, val * gap[of], dims) + l2 * w, gap.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-9)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-9)
    return LinearScorer(w, b)
