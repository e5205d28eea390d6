"""What the two text classifiers share: bounded samples of labelled rows, and scaling of margins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, rows: int) -> DataFrame:
    """(text, y) of about ``rows`` labelled training rows, chosen by a hash of the key; all of them if there are fewer.

    Only keys and labels of the sample are sent to the texts, and their number
    is bounded by 2 * ``rows``. A key with several labels counts as 1 if any is.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & train)
    known = known.groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("y"))
    total = max(1, known.count())
    slots = 1 << 30
    kept = known.where(F.pmod(F.xxhash64("__key"), F.lit(slots)) < int(slots * min(1.0, rows / total))).limit(2 * rows)
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(kept), "__key").select("text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset that turn margins into chances of y = 1, by Newton steps."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    scale = float(np.std(margins)) or 1.0
    x, target = margins / scale, np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * x + b)
        g = np.array([np.sum((p - target) * x) + 1e-3 * a, np.sum(p - target)])
        w = p * (1 - p) + 1e-9
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()))
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3) / scale, b
