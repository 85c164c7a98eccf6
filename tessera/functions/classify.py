"""Classes of a numeric column: quantiles, equal intervals, natural breaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values on which natural breaks are optimal; more are first gathered into as many quantiles.
DISTINCT = 1_000


def breaks(df: DataFrame, column: str, scheme: str = "quantiles", k: int = 5) -> list[float]:
    """Upper ends of the classes but the last."""
    if scheme == "quantiles":
        row = df.agg(F.percentile(column, F.array(*(F.lit(i / k) for i in range(1, k))))).first()[0]
        return sorted(set(row or []))
    if scheme == "equal_interval":
        lo, hi = df.agg(F.min(column), F.max(column)).first()
        return [lo + (hi - lo) * i / k for i in range(1, k)]
    if scheme != "natural_breaks":
        raise ValueError(f"unknown scheme {scheme!r}")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    if counts.limit(DISTINCT + 1).count() > DISTINCT:
        edges = df.agg(F.percentile(column, F.array(*(F.lit((i + 0.5) / DISTINCT) for i in range(DISTINCT))))).first()[0]
        values, n = np.unique(edges, return_counts=True)
    else:
        rows = sorted(map(tuple, counts.collect()))
        values, n = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    return fisher_jenks(values, n, k)


def fisher_jenks(values: np.ndarray, n: np.ndarray, k: int) -> list[float]:
    """Breaks of least within-class sum of squares for sorted distinct values."""
    m, k = len(values), min(k, len(values))
    c, s, q = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * values, n * values * values))

    def cost(a, b):  # values a to b - 1
        return q[b] - q[a] - (s[b] - s[a]) ** 2 / np.maximum(c[b] - c[a], 1e-300)

    best = np.array([cost(0, j) if j else 0.0 for j in range(m + 1)])
    back = []
    for _ in range(1, k):
        new, at = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for j in range(1, m + 1):
            a = np.arange(j)
            total = best[a] + cost(a, j)
            at[j] = int(total.argmin())
            new[j] = total[at[j]]
        best = new
        back.append(at)
    out, j = [], m
    for at in reversed(back):
        j = int(at[j])
        if 0 < j:
            out.append(float(values[j - 1]))
    return sorted(out)


def class_of(column: Column, ends: list[float]) -> Column:
    """0 for values up to the first end, and so on; null stays null."""
    out = F.lit(len(ends))
    for i in range(len(ends) - 1, -1, -1):
        out = F.when(column <= ends[i], i).otherwise(out)
    return F.when(column.isNotNull(), out)


def classified(df: DataFrame, column: str, scheme: str = "quantiles", k: int = 5) -> DataFrame:
    return df.withColumn(f"{column}_class", class_of(F.col(column), breaks(df, column, scheme, k)))
