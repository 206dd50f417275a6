"""Small logistic regressions fitted on bounded labelled samples (numpy)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25, unknown: float = 0.0) -> np.ndarray:
    """Weights (bias last) by Newton steps; the bias is not penalised. One class only: a constant model; no rows: ``unknown`` as bias."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = unknown if len(y) == 0 else (6.0 if y[0] else -6.0)
        return w
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def folds(ids: np.ndarray, k: int = 5) -> np.ndarray:
    """Fold of each row, by its place in the sample."""
    return np.arange(len(ids)) % k


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents (the least by a hash of the id) with ``y``, their label of one column.

    The labels are cut to the bound first, so what is broadcast has at most ``limit`` rows. Null labels of this column do not
    count; labels that contradict each other for one id count by their maximum. ``docs`` has a column doc_id and none of name y.
    """
    some = (
        labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y is not null")
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.join(F.broadcast(some), "doc_id")
