"""Rounding and exact spread expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Round a double the way array libraries do: scale, round half to even, unscale."""
    scale = F.lit(float(10**digits))
    return F.rint(value.cast("double") * scale) / scale


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def sample_std_of_integers(value: Column) -> Column:
    """Sample standard deviation of an integer column from two integer sums.

    Integer sums do not depend on the order of merging, so neither does the result.
    NULL for fewer than two values.
    """
    n = F.count(value)
    total = F.sum(value.cast("bigint")).cast("double")
    squares = F.sum(value.cast("bigint") * value.cast("bigint")).cast("double")
    variance = (squares - total * total / n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))
