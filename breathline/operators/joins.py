"""Key-set algebra, interval joins and lookups on the stay id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.functions.rules import PEEP, PEEP_MINIMUM, SUSTAIN_MINUTES
from breathline.operators.series import LONG, SeriesColumns, block_of

WINDOW_BLOCK_MINUTES = 1440
SPREAD = 4
"""Copies of each cohort row, so that one hot (stay, day) is shared by several tasks."""


def common_ids(id_sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Ids present in every set, each once."""
    first, *rest = [s.select(key) for s in id_sets]
    return reduce(lambda left, right: left.join(right, key, "left_semi"), rest, first.distinct())


def with_ids(df: DataFrame, id_sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in the union of the id sets."""
    return df.join(union_ids(id_sets, key), key, "left_semi")


def without_ids(df: DataFrame, id_sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the id sets; a NULL id in a set excludes nothing."""
    return df.join(union_ids(id_sets, key), key, "left_anti")


def union_ids(id_sets: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.union, [s.select(key) for s in id_sets]).distinct()


def subtract_ids(wanted: Sequence[DataFrame], unwanted: DataFrame, key: str) -> DataFrame:
    """(A union B ...) except C, on ids."""
    return union_ids(wanted, key).join(unwanted.select(key), key, "left_anti")


def interval_join(
    measurements: DataFrame,
    windows: DataFrame,
    start: str,
    stop: str | None,
    cols: SeriesColumns = LONG,
    closed: str = "left",
    spread: int = SPREAD,
) -> DataFrame:
    """Rows of ``measurements`` inside their stay's window, with the window's columns.

    ``closed='left'`` is start <= t < stop, ``closed='right'`` start < t <= stop,
    and ``stop=None`` leaves the window open. A bounded window is cut into days
    and joined on (stay, day, salt): rows outside every window find no partner
    and one hot stay is handled by many tasks. The salt also holds the input
    partition, as copies of one row have equal hashes.
    """
    key = cols.stay
    t = F.col(cols.time).cast("bigint")
    row_hash = F.xxhash64(*[F.col(c) for c in measurements.columns])
    salt = F.pmod(F.pmod(row_hash, F.lit(spread)) + F.spark_partition_id(), F.lit(spread))
    low, high = F.col(start).cast("bigint"), F.col(stop).cast("bigint") if stop else None
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint")))
    left = measurements.withColumn("_salt", salt)
    right = windows.withColumn("_salt", salts)
    on = [key, "_salt"]
    if stop is not None:
        first, last = (low, high - 1) if closed == "left" else (low + 1, high)
        right = right.filter(first <= last).withColumn(
            "_day",
            F.explode(
                F.sequence(
                    block_of(first, WINDOW_BLOCK_MINUTES),
                    block_of(last, WINDOW_BLOCK_MINUTES),
                    F.lit(WINDOW_BLOCK_MINUTES).cast("bigint"),
                )
            ),
        )
        left = left.withColumn("_day", block_of(t, WINDOW_BLOCK_MINUTES))
        on.append("_day")
    if closed == "left":
        inside = t >= low if stop is None else (t >= low) & (t < high)
    elif closed == "right":
        inside = t > low if stop is None else (t > low) & (t <= high)
    else:
        raise ValueError(f"unknown closed side {closed!r}")
    return left.join(right.hint("merge"), on).filter(inside).drop("_salt", "_day")


def contained_join(
    events: DataFrame, windows: DataFrame, key: str, begin: str, end: str, start: str, stop: str
) -> DataFrame:
    """Events with begin >= start and end < stop, whatever the order of begin and end.

    An event can end before it begins (a missing end stored as 0), so begin
    alone does not tell the window apart: a plain join on the key, in which
    adaptive execution splits a hot one.
    """
    return events.join(windows, key).filter((F.col(begin) >= F.col(start)) & (F.col(end) < F.col(stop)))


def flag_low_peep(
    measurements: DataFrame,
    onsets: DataFrame,
    onset: str = "onset",
    minimum: float = PEEP_MINIMUM,
    lookback: int = SUSTAIN_MINUTES,
    peep: str = PEEP,
    cols: SeriesColumns = LONG,
) -> DataFrame:
    """Add ``low_peep``: a PEEP under ``minimum`` lies in (onset - lookback, onset]."""
    low = measurements.filter((F.col(cols.name) == peep) & (F.col(cols.value) < minimum))
    low = low.select(cols.stay, cols.time).distinct()
    windows = onsets.select(
        F.col("stay_id").alias(cols.stay),
        (F.col(onset) - lookback).alias("_from"),
        F.col(onset).alias("_to"),
    )
    bad = interval_join(low, windows, "_from", "_to", cols, closed="right")
    bad = bad.select(F.col(cols.stay).alias("stay_id")).distinct().withColumn("_bad", F.lit(True))
    return onsets.join(bad, "stay_id", "left").select(
        *onsets.columns, F.coalesce("_bad", F.lit(False)).alias("low_peep")
    )


def reject_low_peep(measurements: DataFrame, onsets: DataFrame, **rule) -> DataFrame:
    """Drop stays with too low a PEEP before the onset; a stay without PEEP passes."""
    return flag_low_peep(measurements, onsets, **rule).filter(~F.col("low_peep")).drop("low_peep")


def star_join(base: DataFrame, key: str, sides: Sequence[tuple[DataFrame, Sequence[Column]]]) -> DataFrame:
    """Left outer star: every side is aggregated to one row per key before it is joined."""
    out = base
    for side, aggregates in sides:
        out = out.join(side.groupBy(key).agg(*aggregates), key, "left")
    return out


def time_spine(
    measurements: DataFrame, names: Sequence[str], cols: SeriesColumns = LONG
) -> DataFrame:
    """All distinct (stay, minute) of the table, with the named values or NULL."""
    keys = [cols.stay, cols.time]
    spine = measurements.select(*keys).distinct()
    values = (
        measurements.filter(F.col(cols.name).isin(list(names)) & F.col(cols.value).isNotNull())
        .groupBy(*keys, cols.name)
        .agg(F.max(cols.value).alias(cols.value))
    )
    return spine.join(values, keys, "left")


def refresh_columns(df: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` of matching keys; ``updates`` has one row per key."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = [
        F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns
    ]
    return df.join(new, key, "left").select(*out)


def lookup_score(ids: DataFrame, scores: DataFrame, key: str, score: str, missing: float = -1) -> DataFrame:
    """(id, score) of the ids with a score that is present and not the missing code."""
    valid = scores.filter(F.col(score).isNotNull() & (F.col(score) != missing))
    return ids.select(key).distinct().join(valid.groupBy(key).agg(F.max(score).alias(score)), key)


def conditions_join(
    left: DataFrame, right: DataFrame, key: str, either: Sequence[Column]
) -> DataFrame:
    """Equi join on the key, then rows that meet at least one condition across both sides."""
    return left.join(right, key).filter(reduce(lambda a, b: a | b, either))


def clipped(df: DataFrame, time: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Half-open time range low <= t < high with constant bounds (pushed to the scan)."""
    if low is not None:
        df = df.filter(F.col(time) >= low)
    if high is not None:
        df = df.filter(F.col(time) < high)
    return df


def rename_synonyms(df: DataFrame, synonyms: Mapping[str, str], name: str = "name") -> DataFrame:
    """Catalogue names for other spellings, as one literal map lookup (no join)."""
    pairs = [F.lit(x) for item in synonyms.items() for x in item]
    return df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.col(name)))


def rename_by_substring(df: DataFrame, synonyms: Mapping[str, str], name: str = "name") -> DataFrame:
    """Variant that matches the spelling anywhere in the name; the first rule wins."""
    rules = [F.when(F.col(name).contains(old), F.lit(new)) for old, new in synonyms.items()]
    return df.withColumn(name, F.coalesce(*rules, F.col(name)))
