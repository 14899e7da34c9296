"""Numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor(c: Column) -> Column:
    return F.floor(c).cast("double")


def ceil(c: Column) -> Column:
    return F.ceil(c).cast("double")


def truncate(c: Column, digits: int = 0) -> Column:
    """Towards zero, to ``digits`` decimals."""
    scale = F.lit(float(10**digits))
    return (F.signum(c) * F.floor(F.abs(c) * scale).cast("double") / scale).cast("double")


def mod(a: Column, b: Column) -> Column:
    """NULL for a zero divisor."""
    return F.try_mod(a, b)


def log(c: Column, base: float | None = None) -> Column:
    """NaN for numbers that have no logarithm."""
    found = F.ln(c) if base is None else F.ln(c) / F.ln(F.lit(float(base)))
    return F.when(c.isNotNull(), F.coalesce(found, F.lit(float("nan"))))


def sign(c: Column) -> Column:
    return F.signum(c).cast("int")


def rand(seed: int | None = None) -> Column:
    """Uniform in [0, 1), drawn anew for each row; with a seed the same for the same plan."""
    return F.rand(seed)
