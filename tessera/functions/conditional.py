"""Conditional functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_(condition: Column, then: Column, other: Column) -> Column:
    """A NULL condition takes ``other``."""
    return F.when(condition, then).otherwise(other)


def decode(value: Column, *rest: Column) -> Column:
    """decode(v, match1, result1, ..., default); NULL never equals NULL."""
    default = rest[-1] if len(rest) % 2 else F.lit(None)
    out = None
    for match, result in zip(rest[0 : len(rest) - 1 : 2], rest[1::2]):
        out = F.when(value == match, result) if out is None else out.when(value == match, result)
    return default if out is None else out.otherwise(default)
