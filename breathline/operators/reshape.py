"""Flags, unions, unpivot and pivot into a fixed header."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from breathline.functions.rules import STATISTICS
from breathline.functions.text import like_any, like_but_not


def flag_columns(
    text: Column, rules: Mapping[str, Sequence[str]], exceptions: Mapping[str, Sequence[str]] | None = None
) -> list[Column]:
    """One ``max(0/1)`` aggregate per rule: 1 where any row of the group matches."""
    exceptions = exceptions or {}
    out = []
    for flag, patterns in rules.items():
        unwanted = exceptions.get(flag)
        hit = like_but_not(text, patterns, unwanted) if unwanted else like_any(text, patterns)
        out.append(F.max(F.when(hit, 1).otherwise(0)).alias(flag))
    return out


def flag_pivot(
    df: DataFrame,
    key: str,
    text: str,
    rules: Mapping[str, Sequence[str]],
    exceptions: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """All flags of a rule table in one aggregate per key."""
    return df.groupBy(key).agg(*flag_columns(F.col(text), rules, exceptions))


def merge_flags(flag_sets: Sequence[DataFrame], key: str, flags: Sequence[str]) -> DataFrame:
    """Largest flag over several sources; a flag no source knows is 0."""
    aligned = []
    for one in flag_sets:
        known = set(one.columns)
        aligned.append(
            one.select(key, *[F.col(f) if f in known else F.lit(0).alias(f) for f in flags])
        )
    merged = reduce(DataFrame.unionByName, aligned)
    return merged.groupBy(key).agg(*[F.coalesce(F.max(f), F.lit(0)).alias(f) for f in flags])


def union_sources(sources: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """UNION ALL of projections that share the columns."""
    return reduce(DataFrame.unionByName, [s.select(*columns) for s in sources])


def union_distinct(sources: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    return union_sources(sources, columns).distinct()


def unpivot_positive(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide columns to (name, value) rows; only positive values stay."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(ids), list(columns), name, value).filter(F.col(value) > 0)


def pivot_statistics(
    stats: DataFrame,
    key: str,
    names: Sequence[str],
    name: str = "name",
    statistics: Sequence[str] = tuple(STATISTICS),
) -> DataFrame:
    """Long statistics to one row per key with ``<name>_<statistic>`` columns; absent = NULL.

    The list of names is given, so no extra job looks for them, and names
    outside the list are dropped.
    """
    known = stats.filter(F.col(name).isin(list(names)))
    return known.groupBy(key).pivot(name, list(names)).agg(*[F.max(s).alias(s) for s in statistics])


def select_header(df: DataFrame, header: Sequence[str]) -> DataFrame:
    """Exactly the header's columns, in order; missing columns are NULL doubles."""
    check_header(header)
    known = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") if c in known else F.lit(None).cast("double").alias(c) for c in header]
    )


def check_header(header: Sequence[str], size: int | None = None) -> None:
    """A header must have unique names (also when case is ignored) and the stated size."""
    folded = [c.lower() for c in header]
    twice = sorted({c for c in folded if folded.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate columns: {twice}")
    if size is not None and len(header) != size:
        raise ValueError(f"expected {size} columns, found {len(header)}")


def check_schema(df: DataFrame, expected: StructType) -> DataFrame:
    """Names and types must agree with ``expected``; returns ``df`` in that column order."""
    actual = {f.name: f.dataType for f in df.schema}
    problems = [f"missing {f.name}" for f in expected if f.name not in actual]
    problems += [
        f"{f.name} is {actual[f.name].simpleString()}, expected {f.dataType.simpleString()}"
        for f in expected
        if f.name in actual and actual[f.name] != f.dataType
    ]
    if problems:
        raise ValueError("; ".join(problems))
    return df.select(*expected.names)
