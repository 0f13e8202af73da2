"""Labelled rows for the classifiers: the fold they may learn from, and a bounded sample of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold labels are never learned from: crc32 of the id as text is divisible by 5 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_ids(labels: DataFrame, label: str, per_class: dict[int, int], key: str = "doc_id") -> DataFrame:
    """Ids and labels outside the held-out fold, at most ``per_class`` of each class, chosen by hash.

    Rows with a null id or label, and ids whose rows disagree, are left out.
    """
    clean = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
             .groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("_max"))
             .where(F.col("label") == F.col("_max")).drop("_max")
             .withColumn("draw", F.md5(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")))))
    out = None
    for value, limit in per_class.items():
        part = clean.where(F.col("label") == value).orderBy("draw", key).limit(limit)
        out = part if out is None else out.unionByName(part)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: (weights with intercept first, means, scales)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    penalty = np.full(z.shape[1], ridge * len(y) / 100 + 1e-6)
    penalty[0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale
