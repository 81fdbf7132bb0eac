"""A small model of which mechanisms a pair of turns shows: logistic regressions over hashed pairs of characters, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

BUCKETS = 1 << 13


def _pairs(text: str) -> set[str]:
    text = "".join(text.split())
    return {text[k : k + 2] for k in range(len(text) - 1)} | set(text)


def features(a: str | None, b: str | None) -> np.ndarray:
    """Buckets of what the first turn has, what the second has, and what both have, each once."""
    x, y = _pairs(a or ""), _pairs(b or "")
    named = [f"a{t}" for t in x] + [f"b{t}" for t in y] + [f"c{t}" for t in x & y] + [f"n{min(len(x & y), 6)}"]
    return np.unique([zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in named])


class RelationModel:
    """Called with two lists of texts it gives a dict of probabilities for each pair, as relation_scores() asks."""

    def __init__(self, keys: tuple[str, ...], weights: np.ndarray, bias: np.ndarray):
        self.keys, self.weights, self.bias = keys, weights, bias

    def __call__(self, a: list[str], b: list[str]) -> list[dict[str, float]]:
        out = []
        for x, y in zip(a, b, strict=True):
            z = self.weights[features(x, y)].sum(axis=0) + self.bias
            out.append(dict(zip(self.keys, (1 / (1 + np.exp(-np.clip(z, -30, 30)))).round(6).tolist(), strict=True)))
        return out


def train(a: list[str], b: list[str], shown: list[set[str]], keys: tuple[str, ...], epochs: int = 120, rate: float = 0.07, decay: float = 1.0) -> RelationModel:
    """Full-batch gradient steps with a rate of its own for each weight (Adagrad). A mechanism that no pair shows, or every, gets that as its
    probability, less one pair's share."""
    rows = [features(x, y) for x, y in zip(a, b, strict=True)]
    y = np.array([[k in s for k in keys] for s in shown], float).reshape(len(rows), len(keys))
    n = max(len(rows), 1)
    of, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    share = (y.sum(axis=0) + 0.5) / (n + 1)
    weights, bias = np.zeros((BUCKETS, len(keys))), np.log(share / (1 - share))
    sums = np.full_like(weights, 1e-6)
    mixed = (y.min(axis=0, initial=1) != y.max(axis=0, initial=0)) if len(rows) else np.zeros(len(keys), bool)
    for _ in range(epochs if mixed.any() else 0):
        z = np.stack([np.bincount(of, weights[flat, k], len(rows)) for k in range(len(keys))], axis=1) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mixed / n
        step = np.stack([np.bincount(flat, g[of, k], BUCKETS) for k in range(len(keys))], axis=1) + decay / n * weights
        sums += step * step
        weights -= rate * step / np.sqrt(sums)
        bias -= rate * g.sum(axis=0)
    return RelationModel(keys, weights.astype(np.float32), bias)
