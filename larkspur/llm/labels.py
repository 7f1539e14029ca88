"""Labelled rows to learn from, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small


def held_out(key: Column) -> Column:
    """Rows that no model learns labels from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """(key, label) of rows outside the held-out third; null labels and keys are left out.
    A key with several labels counts as 1 if any is 1."""
    rows = labels.where(F.col(key).isNotNull() & F.col(column).isNotNull() & ~held_out(F.col(key)))
    return rows.groupBy(key).agg(F.max(F.col(column).cast("int")).alias("label"))


def sampled(labels: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """All of the labels, or where there are more than `rows` of them about `rows` by hash of
    their key: so many less four standard errors are expected. No task gathers them."""
    n = labels.count()
    if n <= rows:
        return labels
    cut = int((rows - 4 * rows**0.5) / n * 2**31)
    return labels.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(2**31)) < cut)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """(key, text, label) of the documents with a training label; n is the number of labels, if known."""
    texts = docs.select(F.col(key), F.col(text_col).alias("text"))
    return texts.join(small(labels, labels.count() if n is None else n), key)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last one the intercept) of a ridge logistic regression by Newton steps."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
