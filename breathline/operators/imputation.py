"""Imputation and scaling. Fitted values are one-row frames used as scalar subqueries.

A fitted row can come from the training rows and be applied to any other rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.functions.numeric import half_even, safe_ratio


def _with_fit(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Attach the one fitted row as the struct column ``_fit``."""
    return df.select("*", fitted.select(F.struct("*").alias("fit")).scalar().alias("_fit"))


def fit_means(df: DataFrame, columns: Sequence[str], above: Mapping[str, float] | None = None) -> DataFrame:
    """One row of column means over valid values, three digits.

    A value is valid if it is present and, for the columns in ``above``, larger
    than the given limit; otherwise if it is not zero.
    """
    above = above or {}

    def valid(c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        return F.when(x > above[c] if c in above else x != 0, x)

    return df.agg(*[half_even(F.avg(valid(c)), 3).alias(c) for c in columns])


def impute_means(
    df: DataFrame, means: DataFrame, columns: Sequence[str], above: Mapping[str, float] | None = None
) -> DataFrame:
    """Missing values (and values at or under the limit in ``above``) become the mean."""
    above = above or {}
    wanted = set(columns)

    def filled(c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        kept = F.when(x > above[c], x) if c in above else x
        return F.coalesce(kept, F.col(f"_fit.`{c}`")).alias(c)

    return _with_fit(df, means).select(
        *[filled(c) if c in wanted else F.col(f"`{c}`") for c in df.columns]
    )


def impute_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def impute_group_means(df: DataFrame, key: str, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """NULL and zero values become the mean of their group, rounded."""
    means = df.groupBy(key).agg(
        *[half_even(F.avg(F.col(c).cast("double")), digits).alias(f"_mean_{c}") for c in columns]
    )
    wanted = set(columns)

    def filled(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.col(f"_mean_{c}")).alias(c)

    return df.join(means, key).select(*[filled(c) if c in wanted else F.col(c) for c in df.columns])


def fit_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.min(F.col(f"`{c}`").cast("double")).alias(f"min_{c}") for c in columns],
        *[F.max(F.col(f"`{c}`").cast("double")).alias(f"max_{c}") for c in columns],
    )


def scale_min_max(
    df: DataFrame, ranges: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Linear map of the fitted range to [low, high]; a constant column maps to ``low``."""
    wanted = set(columns)

    def scaled(c: str) -> Column:
        span = F.col(f"_fit.`max_{c}`") - F.col(f"_fit.`min_{c}`")
        unit = F.coalesce(safe_ratio(F.col(f"`{c}`") - F.col(f"_fit.`min_{c}`"), span), F.lit(0.0))
        return (unit * F.lit(high - low) + F.lit(low)).alias(c)

    return _with_fit(df, ranges).select(
        *[scaled(c) if c in wanted else F.col(f"`{c}`") for c in df.columns]
    )


def fit_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column."""
    return df.agg(
        *[F.avg(f"`{c}`").alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(f"`{c}`").alias(f"sd_{c}") for c in columns],
    )


def scale_z(df: DataFrame, moments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard scores with the population deviation; a constant column maps to 0."""
    wanted = set(columns)

    def scaled(c: str) -> Column:
        centred = F.col(f"`{c}`") - F.col(f"_fit.`mean_{c}`")
        return F.coalesce(safe_ratio(centred, F.col(f"_fit.`sd_{c}`")), F.lit(0.0)).alias(c)

    return _with_fit(df, moments).select(
        *[scaled(c) if c in wanted else F.col(f"`{c}`") for c in df.columns]
    )


def unscale_z(df: DataFrame, moments: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Back from standard scores: ``columns`` maps a scaled column to the fitted one."""
    out = []
    for c in df.columns:
        source = columns.get(c)
        if source is None:
            out.append(F.col(f"`{c}`"))
        else:
            back = F.col(f"`{c}`") * F.col(f"_fit.`sd_{source}`") + F.col(f"_fit.`mean_{source}`")
            out.append(back.alias(c))
    return _with_fit(df, moments).select(*out)


def fit_magnitudes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Decimal exponent of the largest absolute value per column."""
    top = {c: F.max(F.abs(F.col(f"`{c}`").cast("double"))) for c in columns}
    return df.agg(*[F.ceil(F.log10(F.when(x > 0, x))).cast("double").alias(c) for c, x in top.items()])


def scale_decimal(df: DataFrame, magnitudes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide by ten to the fitted exponent."""
    wanted = set(columns)

    def scaled(c: str) -> Column:
        return (F.col(f"`{c}`") / F.pow(F.lit(10.0), F.coalesce(F.col(f"_fit.`{c}`"), F.lit(0.0)))).alias(c)

    return _with_fit(df, magnitudes).select(
        *[scaled(c) if c in wanted else F.col(f"`{c}`") for c in df.columns]
    )
