"""Toxicity score: logistic regression over hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Features of a text are the hashes, modulo 2**BITS, of its lower-cased words, its word pairs, and its pairs of words with one word
between; a feature counts once per text. FTRL-proximal (per-coordinate learning rates, L1 and L2) leaves most weights at exactly
zero, so that the model is a short list of (index, weight).
"""

from __future__ import annotations

import pickle
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import per_text
from .training import fold, labelled_sample, train_once

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
EPOCHS = 5
#: Bounds of the training sample: rows of either label, and bytes of text.
PER_CLASS = 6000
MOST_BYTES = 48 << 20
#: Lower-case letters; ASCII signs, digits excepted, separate words.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def features(raw: bytes) -> np.ndarray:
    """Distinct feature indices of one whole text."""
    words = raw.translate(_CLEAN).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    every = [h, *((h[:-d] * np.uint64(0x9E3779B97F4A7C15) + h[d:]) * np.uint64(m) >> np.uint64(20) for d, m in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)) if len(h) > d)]
    return np.unique(np.concatenate(every) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit(rows: list[tuple[bytes, int]]) -> bytes:
    """The bias, and the indices and weights that aren't zero (at most 2**BITS, in practice some hundreds)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    data = [(np.append(features(t), size), y) for t, y in rows]
    l1 = np.full(size + 1, L1)
    l1[size] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, (np.sign(zi) * l1[i] - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            i, y = data[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i] + g * g)
            z[i] += g - (root - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    used = np.flatnonzero(w[:size])
    return pickle.dumps((float(w[size]), used.astype(np.int32), w[used]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> bytes:
    """The model. Learns from rows outside the held-out fold only; without labelled rows every score is 0.5."""
    return train_once(labelled_sample(docs, labels, id_col, text_col, label_col, folds, held_out, per_class, MOST_BYTES), fit)


def score(docs: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text. Null and empty texts get the score of the bias alone;
    repeated rows are kept; an input column of that name is replaced. The model goes with the tasks: it is bounded by
    2**BITS weights."""

    def start():
        bias, used, values = pickle.loads(model)
        w = np.zeros(1 << BITS)
        w[used] = values
        return lambda raw: (float(1 / (1 + np.exp(-np.clip(bias + w[features(raw)].sum(), -35, 35)))),)

    return per_text(docs, text_col, [(column, "double")], start, keep)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted) for each row, repeated rows and rows with a null id, which are never held out, included; other columns play no part. Null and empty texts
    have the score of a text without features; without labelled rows every score is 0.5; an empty table gives an empty table."""
    scored = score(docs.select(id_col, text_col), train(docs, labels, id_col, text_col), text_col, [id_col])
    return scored.select(id_col, F.coalesce(fold(id_col, 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
