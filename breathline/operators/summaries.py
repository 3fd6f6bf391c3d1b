"""Counts, profiles and mortality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.functions.numeric import is_positive, safe_ratio


def counts_having(df: DataFrame, keys: Sequence[str], having: Column, name: str = "n") -> DataFrame:
    """Row counts per group, groups filtered afterwards."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(having)


def table_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: number of rows and of distinct keys.

    The keys are counted from the distinct set, which spreads over tasks.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(key).alias("n_keys"),
    )


def class_counts(df: DataFrame, label: str, name: str = "n") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias(name))


def label_profile(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels in order."""
    return df.select(label).distinct().orderBy(label)


def conditional_means(
    measurements: DataFrame, names: Sequence[str], stay: str = "stay_id", name: str = "name", value: str = "value"
) -> DataFrame:
    """Mean of the positive values of each named analyte, one row per stay."""
    v = F.col(value).cast("double")
    return measurements.filter(F.col(name).isin(list(names))).groupBy(stay).agg(
        *[F.avg(F.when((F.col(name) == n) & is_positive(v), v)).alias(f"mean_{n}") for n in names]
    )


DEATHS = [("icu", 0), ("day28", 1), ("hospital", 2)]


def mortality_by_band(df: DataFrame, band: str = "severity", detail: str = "detail") -> DataFrame:
    """Deaths per severity band and over all (band NULL).

    For the unit, 28 days and the hospital: ``n_<place>_exact`` counts the one
    death code, ``n_<place>`` all codes up to it; shares are of the cohort and
    of all deaths.
    """
    d = F.col(detail)
    counts = [F.count(F.lit(1)).alias("n"), F.count(F.when(d > -1, 1)).alias("deaths")]
    for place, code in DEATHS:
        counts.append(F.count(F.when(d == code, 1)).alias(f"n_{place}_exact"))
        counts.append(F.count(F.when((d > -1) & (d <= code), 1)).alias(f"n_{place}"))
    table = df.rollup(band).agg(*counts, F.grouping(band).cast("int").alias("is_total"))
    totals = table.filter("is_total = 1").select(F.struct("n", "deaths").alias("t")).scalar()
    rated = table.select("*", totals.alias("_t"))
    shares = []
    for place, _ in DEATHS:
        shares.append(safe_ratio(F.col(f"n_{place}"), F.col("_t.n")).alias(f"{place}_cohort_share"))
        shares.append(safe_ratio(F.col(f"n_{place}"), F.col("_t.deaths")).alias(f"{place}_death_share"))
    return rated.select(*table.columns, *shares)


def mortality_total(df: DataFrame, detail: str = "detail") -> DataFrame:
    """One row of cumulative death counts and rates."""
    d = F.col(detail)
    out = [F.count(F.lit(1)).alias("n")]
    for place, code in DEATHS:
        died = F.coalesce((d > -1) & (d <= code), F.lit(False))
        out.append(F.count(F.when(died, 1)).alias(f"{place}_deaths"))
        out.append(F.avg(died.cast("double")).alias(f"{place}_rate"))
    return df.agg(*out)
