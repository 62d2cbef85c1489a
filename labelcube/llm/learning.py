"""Bounded training samples, hashed word features and small linear models for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, lower_ascii, mix, powers, utf8, words_of

#: Slots of a hashed weight vector: a fixed 1 MB of floats, whatever the data.
SLOTS = 1 << 18


class Spans:
    """64-bit hashes of many spans of the same bytes."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(values)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(values) + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64)
        return (mix(h + np.uint64(kind * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - 18)).astype(np.int32)


def word_features(column, fold: bool) -> tuple[np.ndarray, ...]:
    """For each word of a column of texts: its row, begin, end, and slots of the word, its first 4 and 5 bytes and its last 4.

    fold lower-cases A-Z. The last element is (data, at), the bytes and where rows begin.
    """
    data, at = utf8(column)
    if fold:
        data = lower_ascii(data)
    begin, end, row = words_of(data, at)
    span = Spans(data)
    slots = [span(begin, end, 1)] + [span(begin, np.minimum(end, begin + n), n) for n in (4, 5)] + [span(np.maximum(begin, end - 4), end, 3)]
    return row, begin, end, np.stack(slots, axis=1) if len(begin) else np.zeros((0, 4), np.int32), (data, at)


def sample(labels: DataFrame, most: int, id_: str = "doc_id", salt: str = "") -> DataFrame:
    """At most `most` rows, those of the smallest hashes of the id: the same ones however the rows lie."""
    return labels.orderBy(F.md5(F.concat(F.lit(salt), F.col(id_).cast("string"))), id_).limit(most)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift such that sigmoid(slope * z + shift) is calibrated to the labels y, by Newton's method."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    held = y > 0  # targets short of 0 and 1, by the number of labels of each kind
    y = np.where(held, (held.sum() + 1) / (held.sum() + 2), 1 / ((~held).sum() + 2))
    for _ in range(steps if len(y) else 0):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + 1e-3 * (w - [1, 0])
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])
