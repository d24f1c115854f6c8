"""Quality score from compression: a text is like the class whose zstandard dictionary makes it smaller.

Two dictionaries are trained from good and from bad labelled texts. A whole text is cut into blocks of BLOCK bytes and each block is
compressed with either dictionary; the difference of the two total sizes, over the number of bytes, is one number, and logistic
calibration on labelled rows that the dictionaries haven't seen turns it into a probability.
"""

from __future__ import annotations

import pickle

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import per_text
from .training import fold, labelled_sample, train_once

BLOCK = 1024
DICTIONARY = 64 << 10
#: Bounds of the training sample: rows of either label, and bytes of text.
PER_CLASS = 3000
MOST_BYTES = 48 << 20
LEVEL = 3


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Compressed:
    """The normalised difference of compressed sizes: positive when the good dictionary makes a text smaller."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.both = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in (good, bad)]

    def __call__(self, raw: bytes) -> float:
        good, bad = self.both
        if not raw:
            return 0.0
        size_good = size_bad = 0
        for part in blocks(raw):
            size_good += len(good(part))
            size_bad += len(bad(part))
        return (size_bad - size_good) / len(raw)


def make_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train, the text itself as a raw dictionary."""
    parts = [p for t in texts for p in blocks(t)]
    try:
        if len(parts) < 8:
            raise zstandard.ZstdError("too little text")
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(texts)[:DICTIONARY] or b"none").ljust(8, b"\n")


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(scale, slope, intercept) of a logistic curve by Newton steps with a weak ridge."""
    scale = float(np.std(x)) or 1.0
    a = np.stack((x / scale, np.ones_like(x)), 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2), a.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return scale, float(w[0]), float(w[1])


def fit(rows: list[tuple[bytes, int]]) -> bytes:
    """Dictionaries from every other row of each label, calibration from the rest. The share of the labels in the calibration rows
    is that of the sample."""
    of = {k: [t for t, y in rows if y == k] for k in (0, 1)}
    good, bad = (make_dictionary(of[k][::2]) for k in (1, 0))
    measure = Compressed(good, bad)
    rest = [(measure(t), k) for k in (0, 1) for t in of[k][1::2]]
    x, y = np.array([d for d, _ in rest]), np.array([float(k) for _, k in rest])
    curve = calibrate(x, y) if len(rest) > 1 else (1.0, 0.0, 0.0)
    return pickle.dumps((good, bad, curve))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> bytes:
    """The model, under 200 KB. Learns from rows outside the held-out fold only; without labelled rows every score is 0.5."""
    return train_once(labelled_sample(docs, labels, id_col, text_col, label_col, folds, held_out, per_class, MOST_BYTES), fit)


def score(docs: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text. Null and empty texts get the score of a difference of 0;
    repeated rows are kept; an input column of that name is replaced."""

    def start():
        good, bad, (scale, slope, intercept) = pickle.loads(model)
        measure = Compressed(good, bad)
        return lambda raw: (float(1 / (1 + np.exp(-np.clip(slope * measure(raw) / scale + intercept, -30, 30)))),)

    return per_text(docs, text_col, [(column, "double")], start, keep)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted) for each row, repeated rows and rows with a null id, which are never held out, included; other columns play no part. Null and empty texts
    have the score of a text without features; without labelled rows every score is 0.5; an empty table gives an empty table."""
    scored = score(docs.select(id_col, text_col), train(docs, labels, id_col, text_col), text_col, [id_col])
    return scored.select(id_col, F.coalesce(fold(id_col, 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least so much, with their columns."""
    kept = score(docs, train(docs, labels, id_col, text_col), text_col, None, "__score")
    return kept.where(F.col("__score") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
