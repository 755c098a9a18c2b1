"""Scalar expressions: thresholds, clipping, distances, rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def relu_symmetric(x: Column, tau: float) -> Column:
    """x beyond +-tau, moved towards zero by tau; 0 within, and for NULL."""
    return F.when(x > tau, x - tau).when(x < -tau, x + tau).otherwise(F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean, in any number of dimensions."""
    total = None
    for p, q in zip(a, b, strict=True):
        total = (p - q) * (p - q) if total is None else total + (p - q) * (p - q)
    return F.sqrt(total)


def to_number(x: Column) -> Column:
    """A finite double, or NULL for what isn't one."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def point_wkt(text: Column) -> list[Column]:
    """x and y of ``POINT (x y)``."""
    part = lambda i: F.regexp_extract(text, r"(?i)^\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$", i).try_cast("double")
    return [part(1).alias("x"), part(2).alias("y")]
