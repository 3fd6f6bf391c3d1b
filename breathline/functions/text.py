"""Text predicates and text-to-number conversion (plain Column expressions)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_any(column: Column, patterns: Iterable[str]) -> Column:
    """True where ``column`` matches at least one LIKE pattern; NULL text is no match."""
    terms = [column.like(p) for p in patterns]
    return F.coalesce(reduce(lambda a, b: a | b, terms), F.lit(False))


def like_but_not(column: Column, wanted: Iterable[str], unwanted: Iterable[str]) -> Column:
    return like_any(column, wanted) & ~like_any(column, unwanted)


def contains_ci(column: Column, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(column).contains(needle.lower())


def contains_any_ci(column: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_ci(column, n) for n in needles])


def has_digit(column: Column) -> Column:
    return column.rlike("[0-9]")


def has_letter(column: Column) -> Column:
    return column.rlike("(?i)[a-z]")


def to_number(column: Column) -> Column:
    """Text to DOUBLE; unparsable text is NULL instead of an error."""
    return F.trim(column).try_cast("double")


def number_above(column: Column, limit: float) -> Column:
    """Compare text that holds a number as a number, never as text."""
    return to_number(column) > F.lit(float(limit))
