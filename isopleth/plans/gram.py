"""Sufficient statistics of linear models: one aggregate on the cluster, small matrices on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, cols: list[Column], weight: Column | None = None) -> np.ndarray:
    """The matrix of sums of w * a * b over all pairs of the columns, in one pass with partial sums."""
    w = F.lit(1.0) if weight is None else weight
    at = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*(F.sum(w * cols[i] * cols[j]).alias(f"g{n}") for n, (i, j) in enumerate(at))).first()
    out = np.zeros((len(cols), len(cols)))
    for n, (i, j) in enumerate(at):
        out[i, j] = out[j, i] = row[n] or 0.0
    return out


def predict(names: list[str], beta: np.ndarray) -> Column:
    """beta[0] + sum of the others times their columns."""
    out = F.lit(float(beta[0]))
    for name, b in zip(names, beta[1:], strict=True):
        out = out + F.lit(float(b)) * F.col(name)
    return out
