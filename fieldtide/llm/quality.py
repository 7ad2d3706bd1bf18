"""Ordinal quality classifier: cumulative-link regression on hashed text.

One weight per hashed feature, shared by all grades, gives a text a position; ordered thresholds turn it into the chance
of each grade or better. Features are the text's distinct words, by hash, and the shares of its bytes. Training reads a
bounded sample of rated rows; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldtide.llm.toxicity import WordBuckets, known_buckets, labelled_sample, word_ids

_SHARES = 128


def byte_shares(text: bytes) -> np.ndarray:
    """How much of the text each ASCII byte is, on a logarithmic scale; letters as lower, upper case and the rest."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)[:_SHARES].astype(np.float32)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    counts[65:91] = counts[97:123] = counts[48:58] = 0
    counts[65], counts[97], counts[48] = upper, lower, digits
    return np.log1p(counts * (1000 / max(1, len(text)))) / 7


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(position - thresholds[k - 1]); thresholds ascend."""

    known: np.ndarray
    words: np.ndarray
    shares: np.ndarray
    thresholds: np.ndarray

    def position(self, text: bytes, buckets: WordBuckets) -> float:
        return float(self.words[distinct(word_ids(text, buckets, 0))].sum() * scale(text) + byte_shares(text) @ self.shares)

    def tails(self, position: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(position[:, None] - self.thresholds, -30, 30)))


def distinct(ids: np.ndarray) -> np.ndarray:
    ids = np.unique(ids)
    return ids[ids > 0]


def scale(text: bytes) -> float:
    """Long texts have many distinct words; their sum is damped by the root of the length."""
    return 1 / np.sqrt(1 + len(text) / 50)


def train(texts: list[bytes], grades: np.ndarray, levels: int, least_steps: int = 2000, least_epochs: int = 15, rate: float = 0.1, decay: float = 3e-4, batch: int = 64, seed: int = 5) -> OrdinalModel:
    """Adagrad on the cumulative-link likelihood. Thresholds are a first one and positive steps, so they stay ordered."""
    buckets = WordBuckets()
    raw = [word_ids(t, buckets, 0) for t in texts]
    known = known_buckets(raw, 3)
    table = WordBuckets(known)
    ids = [distinct(word_ids(t, table, 0)) for t in texts]
    scales, shares = np.array([scale(t) for t in texts]), np.stack([byte_shares(t) for t in texts])
    words, weights = np.zeros(known.size + 1), np.zeros(_SHARES)
    first, steps = np.array([-1.0]), np.zeros(levels - 2)
    sums = [np.full_like(p, 1e-3) for p in (words, weights, first, steps)]
    rng = np.random.default_rng(seed)
    for _ in range(max(least_epochs, -(-least_steps * batch // len(texts)))):
        order = rng.permutation(len(texts))
        for k in range(0, order.size, batch):
            chosen = order[k : k + batch]
            thresholds = np.concatenate([first, first + np.cumsum(np.exp(steps))])
            sizes = [ids[i].size for i in chosen]
            flat = np.concatenate([ids[i] for i in chosen])
            row = np.repeat(np.arange(chosen.size), sizes)
            position = np.bincount(row, weights=words[flat], minlength=chosen.size) * scales[chosen] + shares[chosen] @ weights
            above = 1 / (1 + np.exp(-np.clip(position[:, None] - thresholds, -30, 30)))
            full = np.concatenate([np.ones((chosen.size, 1)), above, np.zeros((chosen.size, 1))], axis=1)
            slope = np.concatenate([np.zeros((chosen.size, 1)), above * (1 - above), np.zeros((chosen.size, 1))], axis=1)
            g, here = grades[chosen], np.arange(chosen.size)
            chance = np.maximum(full[here, g] - full[here, g + 1], 1e-9)
            push = -(slope[here, g] - slope[here, g + 1]) / chance / chosen.size
            by_cut = np.zeros_like(full)
            by_cut[here, g] += slope[here, g] / chance / chosen.size
            by_cut[here, g + 1] -= slope[here, g + 1] / chance / chosen.size
            cut = by_cut[:, 1:-1].sum(axis=0)
            touched, inverse = np.unique(flat, return_inverse=True)
            grad = np.bincount(inverse, weights=(push * scales[chosen])[row], minlength=touched.size) + decay * words[touched]
            sums[0][touched] += grad**2
            words[touched] -= rate * grad / np.sqrt(sums[0][touched])
            dense = ((weights, push @ shares[chosen] + decay * weights), (first, np.array([cut.sum()])),
                     (steps, np.cumsum(cut[::-1])[::-1][1:] * np.exp(steps)))
            for (param, d), total in zip(dense, sums[1:]):
                total += d**2
                param -= rate * d / np.sqrt(total)
    thresholds = np.concatenate([first, first + np.cumsum(np.exp(steps))])
    return OrdinalModel(known, words, weights, thresholds)


@dataclass
class Quality:
    """A trained model; None where the sample has a single grade, and then all tails are 1."""

    model: OrdinalModel | None
    levels: int

    @classmethod
    def fit(cls, docs: DataFrame, ratings: DataFrame, levels: int, text: str = "text", doc_id: str = "doc_id", **bounds) -> "Quality":
        """``ratings`` has doc_id and ``grade``, 0 to ``levels`` - 1. Bounds are those of ``labelled_sample``."""
        rows = labelled_sample(docs, ratings, "grade", text, doc_id, **bounds)
        grades = np.array([int(r["y"]) for r in rows], int)
        if len(set(grades.tolist())) < 2:
            return cls(None, levels)
        return cls(train([bytes(r["text"]) for r in rows], grades, levels), levels)

    def tails(self, text: Column) -> Column:
        """The chances of grade 1 or better, 2 or better, and so on, as an array."""
        model, levels = self.model, self.levels

        @F.pandas_udf("array<double>")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            buckets = WordBuckets(model.known) if model else None
            for part in parts:
                if model is None:
                    yield pd.Series([[1.0] * (levels - 1)] * len(part))
                else:
                    at = np.array([model.position((t or "").encode("utf-8", "ignore"), buckets) for t in part])
                    yield pd.Series(list(model.tails(at)))

        return score(text)
