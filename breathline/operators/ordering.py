"""Global order without a global window: running totals, positions, first rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER_BUCKETS = 1024


def quantile_splits(df: DataFrame, column: str, buckets: int = ORDER_BUCKETS) -> list[float]:
    """At most ``buckets - 1`` cut points that spread the rows of ``column`` evenly.

    This runs one job and brings that many numbers, never rows, to the driver.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(column, probabilities, 1 / (2 * buckets))
    return sorted(set(found))


def with_bucket(df: DataFrame, column: str, splits: Sequence[float], name: str = "bucket") -> DataFrame:
    """Range bucket of ``column`` by literal cut points, so that every run agrees on it."""
    inner = [s for s in splits if float("-inf") < s < float("inf")]
    bucketizer = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")],
        inputCol=column,
        outputCol=name,
        handleInvalid="keep",
    )
    if not inner:
        return df.withColumn(name, F.lit(0.0))
    return bucketizer.transform(df)


def running_totals(
    df: DataFrame,
    order_col: str,
    totals: Mapping[str, str],
    keys: Sequence[str] = (),
    descending: bool = False,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Running sums over the order of ``order_col`` (one row per key and value).

    ``totals`` maps a non-negative or signed column to the name of its running
    sum (current row included). Rows are cut into range buckets; each bucket is
    summed on its own and shifted by the total of the buckets before it.
    """
    keys = list(keys)
    if splits is None:
        splits = quantile_splits(df, order_col)
    bucketed = with_bucket(df, order_col, splits)
    order: Column = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inside = (
        Window.partitionBy(*keys, "bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = bucketed.select(
        "*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in totals]
    )
    last = F.min_by if descending else F.max_by
    per_bucket = local.groupBy(*keys, "bucket").agg(
        *[last(f"_in_{c}", order_col).alias(f"_sum_{c}") for c in totals]
    )
    bucket_order = F.col("bucket").desc() if descending else F.col("bucket").asc()
    # at most ORDER_BUCKETS rows per key, whatever the size of the input
    before = (
        Window.partitionBy(*keys, F.lit(0))
        .orderBy(bucket_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = per_bucket.select(
        *keys, "bucket",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_base_{c}") for c in totals],
    )
    joined = local.join(shifts, [*keys, "bucket"])
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_in_{c}") + F.col(f"_base_{c}")).alias(out) for c, out in totals.items()],
    )


def with_position(df: DataFrame, order_col: str, name: str = "position", keys: Sequence[str] = ()) -> DataFrame:
    """1-based position by a unique numeric ``order_col``."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order_col, {"_one": name}, keys).drop("_one")


def slice_rows(df: DataFrame, order_col: str, start: int, stop: int) -> DataFrame:
    """Rows at 0-based positions [start, stop) by a unique numeric ``order_col``."""
    position = F.col("_position")
    return (
        with_position(df, order_col, "_position")
        .filter((position > start) & (position <= stop))
        .drop("_position")
    )


def equal_slices(df: DataFrame, order_col: str, rows: int, name: str = "slice") -> DataFrame:
    """Number consecutive slices of ``rows`` rows in the order of ``order_col``."""
    return with_position(df, order_col, "_position").select(
        *df.columns, F.floor((F.col("_position") - 1) / F.lit(rows)).cast("bigint").alias(name)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``, as an aggregate with map-side combine.

    ``order`` must be ascending columns; NULLs sort first, as in a plain sort.
    """
    packed = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in columns]))
    return df.groupBy(*keys).agg(packed.alias("_first")).select(*keys, *[f"_first.{c}" for c in columns])


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """ORDER BY ... LIMIT n, which Spark runs as a bounded top-n per task."""
    return df.orderBy(*order).limit(n)


def sorted_series(df: DataFrame, *columns: str) -> DataFrame:
    """Globally sorted by range partitioning on all columns, so a hot stay is split too.

    A running row number ends the sort key: ranges can then also cut through copies of one row.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return tied.orderBy(*columns, "_tie").drop("_tie")
