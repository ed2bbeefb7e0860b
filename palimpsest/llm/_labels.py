"""Labelled texts, and logistic regression on a few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Up to so many labels (16 bytes each) go to all executors; beyond, texts and labels are shuffled.
MOST_SENT = 1_000_000


def remainder(ident: str, of: int):
    """crc32 of the id as text, modulo of."""
    return F.crc32(F.col(ident).cast("string")) % of


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, label (0 or 1) of the documents whose label may be learned from; the largest of a document's labels counts."""
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & learn).groupBy(F.col(ident).cast("long").alias("doc_id")).agg((F.max(F.col(label)) > 0).cast("int").alias("label"))
    if known.count() <= MOST_SENT:
        known = F.broadcast(known)
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(known, "doc_id")


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.w[0] + (x - self.mean) / self.scale @ self.w[1:], -30, 30)))
