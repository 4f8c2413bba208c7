"""Folds, bounded labelled samples and a small logistic calibration, shared by
the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that one fit may see. Rows are taken in the order of a hash of
#: doc_id, so the sample is the same in every run.
TRAIN_ROWS = 20_000


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def is_fold(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) mod ``parts`` is ``part``; null is not."""
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents for which ``train``
    (over doc_id) holds. Null labels are ignored; several labels of one doc_id
    count as their mean, rounded."""
    ids = (labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.round(F.avg(label)).cast("int").alias("y"))
           .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    # bounded by ``rows``, so it may be broadcast whatever the labels' size
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select(
        F.col("_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "y")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the last one for a constant) by Newton steps; with one class
    only, the constant alone gives the smoothed base rate."""
    n = len(y)
    rate = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w
    a = np.column_stack([x, np.ones(n)])
    penalty = ridge * np.append(np.ones(x.shape[1]), 1e-6)
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * (penalty * w * w).sum()
    now = loss(w)
    for _ in range(steps):
        p = logistic(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return w


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
