"""Platt calibration: A and B of 1 / (1 + exp(A f + B)) by Newton steps with backtracking; each step is one aggregation of five sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_platt(df: DataFrame, logit: str, target: str, max_iter: int = 100, eps: float = 1e-5, clip_target: bool = True) -> tuple[float, float]:
    """With ``clip_target``, targets 0/1 move to the smoothed (N+ + 1)/(N+ + 2) and 1/(N- + 2)."""
    n_pos, n_all = df.agg(F.sum(F.when(F.col(target) > 0.5, 1).otherwise(0)), F.count("*")).first()
    n_pos = n_pos or 0
    t = F.col(target)
    if clip_target:
        t = F.when(t > 0.5, (n_pos + 1.0) / (n_pos + 2.0)).otherwise(1.0 / (n_all - n_pos + 2.0))
    rows = df.select(F.col(logit).cast("double").alias("f"), t.cast("double").alias("t")).persist()
    try:
        a, b = 0.0, math.log((n_all - n_pos + 1.0) / (n_pos + 1.0))

        def loss(a: float, b: float) -> Column:
            z = F.lit(a) * F.col("f") + b
            return F.sum(F.col("t") * z + F.when(z >= 0, F.log1p(F.exp(-z))).otherwise(-z + F.log1p(F.exp(z))))

        value = rows.agg(loss(a, b)).first()[0] or 0.0
        for _ in range(max_iter):
            p = 1 / (1 + F.exp(F.lit(a) * F.col("f") + b))
            d1, d2 = F.col("t") - p, p * (1 - p)
            g1, g2, h11, h22, h21 = rows.agg(F.sum(F.col("f") * d1), F.sum(d1), F.sum(F.col("f") * F.col("f") * d2), F.sum(d2), F.sum(F.col("f") * d2)).first()
            if abs(g1) < eps and abs(g2) < eps:
                break
            h11, h22 = h11 + 1e-12, h22 + 1e-12
            det = h11 * h22 - h21 * h21
            da, db = -(h22 * g1 - h21 * g2) / det, -(-h21 * g1 + h11 * g2) / det
            slope, step = g1 * da + g2 * db, 1.0
            while step >= 1e-10:
                new = rows.agg(loss(a + step * da, b + step * db)).first()[0]
                if new < value + 1e-4 * step * slope:
                    a, b, value = a + step * da, b + step * db, new
                    break
                step /= 2
            else:
                break
        return a, b
    finally:
        rows.unpersist()


def apply_platt(f: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(a * f + b))
