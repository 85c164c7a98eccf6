"""Kernel and variogram functions of a distance as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian(d: Column, h: Column) -> Column:
    return F.exp(-F.pow(d / h, 2))


def bisquare(d: Column, h: Column) -> Column:
    return F.when(d < h, F.pow(1 - F.pow(d / h, 2), 2)).otherwise(0.0)


def tricube(d: Column, h: Column) -> Column:
    return F.when(d < h, F.pow(1 - F.pow(d / h, 3), 3)).otherwise(0.0)


def exponential(d: Column, h: Column) -> Column:
    return F.exp(-d / h)


def boxcar(d: Column, h: Column) -> Column:
    return F.when(d <= h, 1.0).otherwise(0.0)


def triangular(d: Column, h: Column) -> Column:
    return F.when(d < h, 1 - d / h).otherwise(0.0)


KERNELS = {f.__name__: f for f in (gaussian, bisquare, tricube, exponential, boxcar, triangular)}
#: Kernels that are zero from some distance on.
COMPACT = {"bisquare", "tricube", "boxcar", "triangular"}


def kernel(name: str):
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; one of {sorted(KERNELS)}")
    return KERNELS[name]


def numpy_kernel(name: str):
    """The same functions on arrays."""
    return {
        "gaussian": lambda d, h: np.exp(-((d / h) ** 2)),
        "bisquare": lambda d, h: np.where(d < h, (1 - (d / h) ** 2) ** 2, 0.0),
        "tricube": lambda d, h: np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0),
        "exponential": lambda d, h: np.exp(-d / h),
        "boxcar": lambda d, h: np.where(d <= h, 1.0, 0.0),
        "triangular": lambda d, h: np.where(d < h, 1 - d / h, 0.0),
    }[name]


def density_1d(u: Column, name: str = "gaussian") -> Column:
    """One factor of a product density kernel."""
    if name == "gaussian":
        return F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)
    if name == "epanechnikov":
        return F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)
    raise ValueError(f"unknown density kernel {name!r}")


@dataclass(frozen=True)
class Variogram:
    """nugget + psill * g(h / range), 0 at distance 0; ``range`` is where the sill is (nearly) reached."""

    model: str = "spherical"
    nugget: float = 0.0
    psill: float = 1.0
    range: float = 1.0
    signed: bool = False  # cross-variograms may have negative parts

    def __post_init__(self):
        if self.model not in ("spherical", "exponential", "gaussian"):
            raise ValueError(f"unknown variogram model {self.model!r}")
        if self.range <= 0 or (not self.signed and (self.nugget < 0 or self.psill < 0)):
            raise ValueError("range must be positive, and nugget and psill at least 0")

    @property
    def sill(self) -> float:
        return self.nugget + self.psill

    def shape(self, h: np.ndarray) -> np.ndarray:
        r = np.asarray(h, float) / self.range
        if self.model == "spherical":
            r = np.minimum(r, 1)
            return 1.5 * r - 0.5 * r**3
        return 1 - np.exp(-3 * (r if self.model == "exponential" else r**2))

    def gamma(self, h: np.ndarray) -> np.ndarray:
        h = np.asarray(h, float)
        return np.where(h == 0, 0.0, self.nugget + self.psill * self.shape(h))

    def covariance(self, h: np.ndarray) -> np.ndarray:
        return self.sill - self.gamma(h)

    def gamma_column(self, h: Column) -> Column:
        r = h / self.range
        if self.model == "spherical":
            r = F.least(r, F.lit(1.0))
            g = 1.5 * r - 0.5 * r * r * r
        else:
            g = 1 - F.exp(-3 * (r if self.model == "exponential" else r * r))
        return F.when(h == 0, 0.0).otherwise(self.nugget + self.psill * g)
