"""A binary maximum-entropy model over hashed features, fitted on a bounded sample on the driver."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16


def hashed(features: list[str]) -> list[int]:
    return [crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in features]


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 6, l2: float = 1e-6, rate: float = 0.15) -> np.ndarray:
    """Weights for rows of hashed feature ids, by mini-batches with per-weight step sizes; the same every time."""
    w = np.zeros(1 << BITS)
    if not len(y):
        return w
    rng = np.random.default_rng(2)
    g2 = np.full(1 << BITS, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 512):
            b = order[i : i + 512]
            xb = x[b]
            p = 1 / (1 + np.exp(-np.clip(w[xb].sum(axis=1), -30, 30)))
            at, inv = np.unique(xb, return_inverse=True)
            g = np.bincount(inv.ravel(), np.repeat(p - y[b], x.shape[1])) / len(b) + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def bounded_sample(df: DataFrame, id_col: str, col: str, size: int, salt: str) -> list:
    """The values of ``col`` in the ``size`` rows with the least hash of the id (ties by value).

    Rows beyond twice the wanted share of the hash range are filtered where they are read, so that all tasks
    together send about twice the sample to the driver, however many tasks there are.
    """
    n = df.count()
    h = F.xxhash64(F.col(id_col), F.lit(salt))
    t = df.select(h.alias("_h"), F.col(col).alias("_v"))
    if n > 4 * size:
        t = t.filter(F.col("_h") < F.lit(int(-(2**63) + 2**64 * 2 * size / n)))
    return [r["_v"] for r in t.orderBy("_h", "_v").limit(size).collect()]
