"""A bounded, reproducible sample of labelled documents, and a one-variable logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> DataFrame:
    """(label, text) of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    The ids are at most ``most`` rows, which bounds what is broadcast; the documents are read in place.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), parts) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def platt(x: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (never negative) and intercept of a logistic fit with smoothed targets; (1, 0) without both classes."""
    pos, neg = float((label == 1).sum()), float((label == 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.std(x)) or 1.0
    z, w = x / scale, np.array([1.0, 0.0])
    for _ in range(steps):
        p = logistic(w[0] * z + w[1])
        g = np.array([((p - target) * z).sum() + 1e-3 * w[0], (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])) / scale, float(w[1])
