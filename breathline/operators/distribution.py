"""Exact distribution statistics per group, for groups of any size.

The built-in exact median keeps all distinct values of a group in one task.
Here equal values are counted first (map-side combine); the counts are cut
into value buckets whose bounds come from a fixed monotone function, and only
the buckets that hold a wanted rank are looked into. A group has at most
``MAX_BUCKETS`` bucket rows, whatever its size; a bucket crowded with different
values is cut further, at quantiles of a sample of them, and only the pieces that hold a
wanted rank by exact counts are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from breathline.functions.numeric import half_even, is_positive, safe_ratio

BUCKETS_PER_STEP = 256
UNIT = 1e-6
# log(1 + x / UNIT) is under 724 for every double, and there are two signs
MAX_BUCKETS = 2 * 724 * BUCKETS_PER_STEP + 1
PIECE = 20_000
"""Different values of a bucket that one task may order; more are cut into ``PIECES``."""
PIECES = 64
PER_PIECE = 64


def value_bucket(value: Column) -> Column:
    """Monotone bucket number, about 0.4 % wide in relative terms."""
    size = F.floor(F.log1p(F.abs(value) / F.lit(UNIT)) * BUCKETS_PER_STEP)
    return (F.signum(value) * size).cast("bigint")


def _bucket_centre(bucket: Column) -> Column:
    """A value near the bucket, used as origin for sums of squares."""
    return F.signum(bucket) * F.expm1(F.abs(bucket) / BUCKETS_PER_STEP) * UNIT


def distribution(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
) -> DataFrame:
    """Per group: n, mean, var_pop, min_value, max_value and exact quantiles.

    ``quantiles`` maps an output column to a probability; positions between two
    values are interpolated linearly. NULL and NaN values are left out.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, (v + F.lit(0.0)).alias("v"))
    counts = rows.groupBy(*keys, value_bucket(F.col("v")).alias("bucket"), "v").agg(
        F.count(F.lit(1)).alias("n")
    )
    away = F.col("v") - _bucket_centre(F.col("bucket"))
    per_bucket = (
        counts.groupBy(*keys, "bucket")
        .agg(
            F.sum("n").alias("bn"),
            F.count(F.lit(1)).alias("distinct"),
            F.sum(F.col("n") * away).alias("d1"),
            F.sum(F.col("n") * away * away).alias("d2"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        )
        .withColumn("bmean", _bucket_centre(F.col("bucket")) + F.col("d1") / F.col("bn"))
        .withColumn("m2", F.greatest(F.lit(0.0), F.col("d2") - F.col("d1") * F.col("d1") / F.col("bn")))
    )
    group = Window.partitionBy(*keys, F.lit(0))
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        per_bucket.withColumn("total", F.sum("bn").over(group))
        .withColumn("mean", F.sum(F.col("bn") * F.col("bmean")).over(group) / F.col("total"))
        .withColumn("base", F.coalesce(F.sum("bn").over(before), F.lit(0)))
    )
    shift = F.col("bmean") - F.col("mean")
    placed = placed.select(
        *keys, "bucket", "bn", "distinct", "total", "mean", "base",
        (F.sum(F.col("m2") + F.col("bn") * shift * shift).over(group) / F.col("total")).alias("var_pop"),
        F.min("lo").over(group).alias("min_value"),
        F.max("hi").over(group).alias("max_value"),
    )

    def spot(p: float) -> Column:
        return (F.col("total") - 1) * F.lit(float(p))

    def holds(rank: Column, start: Column, stop: Column) -> Column:
        return (start <= rank) & (rank < stop)

    def wanted(size: Column) -> Column:
        """Holds a wanted rank: ``size`` values that begin at the rank ``base``."""
        ranks = [edge(spot(p)) for p in quantiles.values() for edge in (F.floor, F.ceil)]
        return reduce(or_, [holds(rank, F.col("base"), F.col("base") + size) for rank in ranks], F.lit(False))

    placed = placed.filter(wanted(F.col("bn")))
    plain = counts.join(placed.filter(F.col("distinct") <= PIECE), [*keys, "bucket"]).withColumn("piece", F.lit(0))
    crowded = _wanted_pieces(counts, placed.filter(F.col("distinct") > PIECE), keys, wanted)
    picked = plain.unionByName(crowded.select(plain.columns))
    upto = Window.partitionBy(*keys, "bucket", "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = picked.withColumn("_stop", F.col("base") + F.sum("n").over(upto))
    stop, start = F.col("_stop"), F.col("_stop") - F.col("n")
    out, final = [], []
    for name, p in quantiles.items():
        low, high = F.floor(spot(p)), F.ceil(spot(p))
        out.append(F.max(F.when(holds(low, start, stop), F.col("v"))).alias(f"_{name}_low"))
        out.append(F.max(F.when(holds(high, start, stop), F.col("v"))).alias(f"_{name}_high"))
        part = (F.col("n_rows") - 1) * F.lit(float(p))
        gap = F.col(f"_{name}_high") - F.col(f"_{name}_low")
        final.append((F.col(f"_{name}_low") + gap * (part - F.floor(part))).alias(name))
    return (
        picked.groupBy(*keys)
        .agg(
            F.max("total").alias("n_rows"),
            F.max("mean").alias("mean"),
            F.max("var_pop").alias("var_pop"),
            F.max("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            *out,
        )
        .select(*keys, F.col("n_rows").alias("n"), "mean", "var_pop", "min_value", "max_value", *final)
    )


def _wanted_pieces(counts: DataFrame, buckets: DataFrame, keys: Sequence[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """The counted values that share a piece with a wanted rank, with ``piece`` and the rank ``base`` at which it begins.

    Each of the crowded ``buckets`` is cut at the quantiles of those different
    values whose hashes are smallest. This sample merges like a sketch but has no
    coin flips: a recomputed task gives the same cuts. It only proposes them: the
    values of each piece are counted exactly, so a rank is never looked for in the
    wrong piece. About 1/64 of a crowded bucket is ordered by one task.
    """
    place = [*keys, "bucket"]
    rows = counts.join(buckets, place)
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    thin = rows.filter(share * F.col("distinct") < float(PIECES * PER_PIECE))
    ends = thin.groupBy(*place).agg(F.sort_array(F.collect_list("v")).alias("seen"))
    at = F.sequence(F.lit(1), F.lit(PIECES - 1))
    cut = F.transform(at, lambda i: F.element_at("seen", F.ceil(i * F.size("seen") / PIECES).cast("int")))
    rows = rows.join(ends.select(*place, cut.alias("cuts")), place, "left")
    below = F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c <= F.col("v"))
    rows = rows.withColumn("piece", F.size(below)).drop("cuts")
    before = Window.partitionBy(*place).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        rows.groupBy(*place, "piece")
        .agg(F.sum("n").alias("pn"), F.max("base").alias("base"), F.max("total").alias("total"))
        .withColumn("base", F.col("base") + F.coalesce(F.sum("pn").over(before), F.lit(0)))
        .filter(wanted(F.col("pn")))
    )
    return rows.drop("base", "total").join(pieces, [*place, "piece"])


def feature_statistics(
    measurements: DataFrame, keys: Sequence[str] = ("stay_id", "name"), value: str = "value"
) -> DataFrame:
    """Median, population variance and change rate of the positive values, two digits."""
    valid = measurements.filter(is_positive(F.col(value)))
    stats = distribution(valid, keys, value, {"median": 0.5})
    rate = safe_ratio(F.col("max_value") - F.col("min_value"), F.col("min_value"))
    return stats.select(
        *keys,
        half_even(F.col("median"), 2).alias("median"),
        half_even(F.col("var_pop"), 2).alias("variances"),
        half_even(rate, 2).alias("changerate"),
    )


def box_statistics(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the number of outliers."""
    keys = list(keys)
    box = distribution(df, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    box = box.select(
        *keys, "n", "q1", "q2", "q3",
        (F.col("q1") - reach).alias("low_fence"),
        (F.col("q3") + reach).alias("high_fence"),
    )
    v = F.col(value).cast("double")
    if keys:
        joined = df.join(box, keys)
    else:
        fences = box.select(F.struct("*").alias("box")).scalar()
        joined = df.select(value, fences.alias("_box")).select(value, "_box.*")
    within = (v >= F.col("low_fence")) & (v <= F.col("high_fence"))
    same = [F.max(c).alias(c) for c in ("n", "q1", "q2", "q3")]
    return joined.groupBy(*keys).agg(
        *same,
        F.min(F.when(within, v)).alias("whisker_low"),
        F.max(F.when(within, v)).alias("whisker_high"),
        F.count(F.when(~within, 1)).alias("outliers"),
    )


def normal_fit(df: DataFrame, value: str, sample: bool = False, missing: float | None = None) -> DataFrame:
    """One row (mu, sigma): maximum likelihood, or with the sample deviation."""
    v = F.col(value).cast("double")
    if missing is not None:
        v = F.coalesce(v, F.lit(float(missing)))
    deviation = F.stddev_samp(v) if sample else F.stddev_pop(v)
    return df.agg(F.avg(v).alias("mu"), deviation.alias("sigma"))


def density_curve(fit: DataFrame, start: float, stop: float, step: float) -> DataFrame:
    """Normal density over a grid of equally spaced points: (x, density)."""
    points = int(round((stop - start) / step))
    grid = fit.select("mu", "sigma", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i"))
    x = F.lit(float(start)) + F.col("i") * F.lit(float(step))
    z = safe_ratio(x - F.col("mu"), F.col("sigma"))
    scale = safe_ratio(F.lit(1.0), F.col("sigma") * F.sqrt(F.lit(2.0) * F.pi()))
    return grid.select("i", F.round(x, 6).alias("x"), (scale * F.exp(-z * z / 2)).alias("density"))
