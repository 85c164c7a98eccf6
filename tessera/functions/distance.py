"""Distances as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: mean Earth radius in km.
EARTH_KM = 6371.0


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def cityblock(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def chebyshev(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.abs(x1 - x2), F.abs(y1 - y2))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between points in degrees."""
    rad = math.pi / 180
    a = F.pow(F.sin((lat2 - lat1) * rad / 2), 2) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


METRICS = {"euclidean": euclidean, "sqeuclidean": squared, "cityblock": cityblock, "chebyshev": chebyshev, "haversine": haversine}


def metric(name: str):
    """The distance of this name; ``haversine`` takes latitude before longitude."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(METRICS)}")
    return METRICS[name]


def space_time(x1: Column, y1: Column, t1: Column, x2: Column, y2: Column, t2: Column, weight: float) -> Column:
    """sqrt(ds^2 + weight * dt^2)."""
    dx, dy, dt = x1 - x2, y1 - y2, t1 - t2
    return F.sqrt(dx * dx + dy * dy + weight * dt * dt)


def normalised(df: DataFrame, *columns: str) -> DataFrame:
    """Each column scaled to 0..1 by its range; a constant column becomes 0."""
    ends = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"_lo_{c}")) / F.when(span == 0, 1.0).otherwise(span))
    return out.select(df.columns)
