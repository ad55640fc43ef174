"""What both classifiers share: folds, a bounded sample of labelled rows, and a logistic fit on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled ids of each class, chosen by a hash of the id, not by place. A stored table.

    An id with both labels counts as 1, an id in several rows by its least text. The chosen ids, at most 2 * per_class of them, are broadcast to the scan of docs.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.withColumn("o", F.xxhash64("doc_id"))
    chosen = [y.where(F.col("y") == k).orderBy("o", "doc_id").limit(per_class) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).drop("o")
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return stored(met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; the last weight is the intercept. Constant labels give a constant score."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    eye = np.eye(len(w)) * ridge
    eye[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + eye, a.T @ (p - y) + eye @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
