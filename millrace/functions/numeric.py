"""Column helpers for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double, null where it is missing, NaN or infinite."""
    d = c.try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def safe_div(n: Column, d: Column, least: float = 1e-12) -> Column:
    """n / d, null where a side is null or the divisor is below ``least``."""
    return F.when(F.abs(d) >= least, n / d)


def finite_div(n: Column, d: Column) -> Column:
    """n / d, null where that is not a finite number."""
    return F.when(d != 0, n / d)
