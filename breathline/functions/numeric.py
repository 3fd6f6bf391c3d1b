"""Numeric expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE = 1e-6
"""Values at or below this count as not measured."""


def is_positive(column: Column) -> Column:
    return column > F.lit(POSITIVE)


def positive_or_null(column: Column) -> Column:
    return F.when(column > 0, column)


def half_even(column: Column, digits: int) -> Column:
    """Banker's rounding as on decimals: binary noise past six digits is dropped first."""
    return F.bround(F.round(column, 6), digits)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def whole_days(minutes: Column) -> Column:
    """Minutes to whole days, truncated toward zero like integer division."""
    m = minutes.cast("bigint")
    # take the remainder off first: the quotient is then exact
    return ((m - m % F.lit(1440)) / F.lit(1440)).cast("bigint")


def enrollment_from_onset(onset: Column, delay: int = 1440) -> Column:
    return onset + F.lit(delay)


def binary_label(status: Column, positive: int = 1) -> Column:
    return (status == F.lit(positive)).cast("int")


def collapse_classes(status: Column, top: int = 2) -> Column:
    """Every class above ``top`` becomes ``top``."""
    return F.least(status, F.lit(top))
