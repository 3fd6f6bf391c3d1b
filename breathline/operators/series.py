"""Pairing of two sparse series and sustained-condition rules, per stay.

A stay may hold a large share of all rows, so no window is ever partitioned by
the stay alone. Rows are first reduced to one per (stay, minute) with map-side
combine, and then cut into blocks of ``BLOCK_MINUTES``: a window over
(stay, block) sees at most that many rows. What crosses a block border (last
value, open run, last failing time) travels through one summary row per block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from breathline.functions.clinical import MILD_PF, fio2_fraction, severity_band
from breathline.functions.numeric import is_positive
from breathline.functions.rules import FIO2, PAO2, SUSTAIN_MINUTES

BLOCK_MINUTES = 7 * 1440


@dataclass(frozen=True)
class SeriesColumns:
    """Names of the long measurement table's columns."""

    stay: str = "stay_id"
    time: str = "offset_min"
    name: str = "name"
    value: str = "value"


LONG = SeriesColumns()


def block_of(time: Column, minutes: int = BLOCK_MINUTES) -> Column:
    """First minute of the block that holds ``time`` (also right below zero)."""
    return (time - F.pmod(time, F.lit(minutes).cast("bigint"))).cast("bigint")


def _within_block() -> Window:
    return (
        Window.partitionBy("stay_id", "block")
        .orderBy("offset_min")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _earlier_blocks() -> Window:
    return (
        Window.partitionBy("stay_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def one_row_per_minute(
    measurements: DataFrame,
    first: str = PAO2,
    second: str = FIO2,
    cols: SeriesColumns = LONG,
    block_minutes: int = BLOCK_MINUTES,
    fill: str = "null",
) -> DataFrame:
    """(stay, minute) rows holding the largest value of each of two analytes.

    ``a`` and ``b`` are NULL where the analyte is absent and NaN where it is
    present without a usable value (to be replaced by the stay's mean): a NULL
    value, or with ``fill='nonpositive'`` also a vanishing one.
    """
    name, value = F.col(cols.name), F.col(cols.value).cast("double")
    usable = value.isNotNull() & ~F.isnan(value)
    if fill == "nonpositive":
        usable = usable & is_positive(value)
    elif fill != "null":
        raise ValueError(f"unknown fill rule {fill!r}")
    time = F.col(cols.time).cast("bigint")

    def analyte(which: str) -> tuple[Column, Column]:
        return F.max(F.when((name == which) & usable, value)), F.max(F.when(name == which, 1))

    a, a_seen = analyte(first)
    b, b_seen = analyte(second)
    nan = F.lit(float("nan"))
    return (
        measurements.filter(name.isin(first, second))
        .groupBy(
            F.col(cols.stay).alias("stay_id"),
            block_of(time, block_minutes).alias("block"),
            time.alias("offset_min"),
        )
        .agg(a.alias("a"), a_seen.alias("a_seen"), b.alias("b"), b_seen.alias("b_seen"))
        # said here, both uses of this frame push down the same filter and share its exchange
        .filter(F.col("stay_id").isNotNull() & F.col("block").isNotNull())
        .select(
            "stay_id",
            "block",
            "offset_min",
            F.when(F.col("a_seen") == 1, F.coalesce("a", nan)).alias("a"),
            F.when(F.col("b_seen") == 1, F.coalesce("b", nan)).alias("b"),
        )
    )


def carry_forward(minutes: DataFrame) -> DataFrame:
    """Last observation carried forward for both analytes, plus stay totals.

    Adds ``a_held``/``b_held`` (latest value at or before the minute),
    ``a_mean``/``b_mean`` (mean of the stay's positive values) and
    ``last_minute`` (the stay's last minute).
    """
    w = _within_block()
    held = minutes.select(
        "*",
        F.last("a", ignorenulls=True).over(w).alias("a_block"),
        F.last("b", ignorenulls=True).over(w).alias("b_block"),
    )

    def positive(c: str) -> Column:
        return F.when(is_positive(F.col(c)) & ~F.isnan(c), F.col(c))

    per_block = held.groupBy("stay_id", "block").agg(
        F.sum(positive("a")).alias("a_sum"),
        F.count(positive("a")).alias("a_n"),
        F.sum(positive("b")).alias("b_sum"),
        F.count(positive("b")).alias("b_n"),
        F.max_by("a_block", "offset_min").alias("a_tail"),
        F.max_by("b_block", "offset_min").alias("b_tail"),
        F.max("offset_min").alias("block_last"),
    )
    stay, earlier = Window.partitionBy("stay_id"), _earlier_blocks()
    carried = per_block.select(
        "stay_id",
        "block",
        F.last("a_tail", ignorenulls=True).over(earlier).alias("a_carry"),
        F.last("b_tail", ignorenulls=True).over(earlier).alias("b_carry"),
        F.try_divide(F.sum("a_sum").over(stay), F.sum("a_n").over(stay)).alias("a_mean"),
        F.try_divide(F.sum("b_sum").over(stay), F.sum("b_n").over(stay)).alias("b_mean"),
        F.max("block_last").over(stay).alias("last_minute"),
    )
    return held.join(carried, ["stay_id", "block"]).select(
        "stay_id", "block", "offset_min", "a", "b", "a_mean", "b_mean", "last_minute",
        F.coalesce("a_block", "a_carry").alias("a_held"),
        F.coalesce("b_block", "b_carry").alias("b_held"),
    )


def pair_series(
    measurements: DataFrame,
    first: str = PAO2,
    second: str = FIO2,
    cols: SeriesColumns = LONG,
    fill: str = "null",
    drop_unpaired_tail: bool = True,
    block_minutes: int = BLOCK_MINUTES,
) -> DataFrame:
    """As-of (backward) pairing of two series and their ratio.

    Returns (stay_id, block, offset_min, pao2, fio2, pf): one row per minute at
    which both analytes are known. Stays with only one analyte give no rows.
    """
    minutes = one_row_per_minute(measurements, first, second, cols, block_minutes, fill)
    held = carry_forward(minutes)
    known = (
        F.col("a_mean").isNotNull()
        & F.col("b_mean").isNotNull()
        & F.col("a_held").isNotNull()
        & F.col("b_held").isNotNull()
    )
    if drop_unpaired_tail:
        lone = F.col("a").isNull() | F.col("b").isNull()
        known = known & ~(lone & (F.col("offset_min") == F.col("last_minute")))

    def filled(which: str) -> Column:
        c = F.col(f"{which}_held")
        return F.when(F.isnan(c), F.col(f"{which}_mean")).otherwise(c)

    return (
        held.filter(known)
        .select(
            "stay_id", "block", "offset_min",
            filled("a").alias("pao2"),
            fio2_fraction(filled("b"), F.col("b_mean")).alias("fio2"),
        )
        .withColumn("pf", F.try_divide("pao2", "fio2"))
    )


def _run_starts(pairs: DataFrame, threshold: float) -> DataFrame:
    """Mark passing rows and, per row, the start of its run inside the block."""
    ordered = Window.partitionBy("stay_id", "block").orderBy("offset_min")
    w = _within_block()
    ok = F.coalesce(F.col("pf") <= threshold, F.lit(False))
    marked = pairs.withColumn("ok", ok).withColumn("ok_before", F.lag("ok").over(ordered))
    opens = F.col("ok") & ~F.coalesce(F.col("ok_before"), F.lit(False))
    return marked.select(
        "stay_id", "block", "offset_min", "pf", "ok",
        F.last(F.when(opens, F.col("offset_min")), ignorenulls=True).over(w).alias("opened"),
        F.count(F.when(~F.col("ok"), 1)).over(w).alias("fails"),
    )


def sustained_onset(
    pairs: DataFrame, threshold: float = MILD_PF, sustain: int = SUSTAIN_MINUTES
) -> DataFrame:
    """First minute at which the ratio stayed at or under ``threshold`` long enough.

    Within a maximal run of passing pairs this is the first pair at least
    ``sustain`` minutes after the run's first; or the stay's last pair if it
    ends a run of two or more; or the only pair of a stay.
    Returns (stay_id, onset, min_pf, severity, n_pairs); onset NULL = never.

    Runs that start inside a block are settled there. Of the run that is open
    when a block begins, only its minutes are kept (at most one per minute of
    the block), and settled once the summary rows tell when it started.
    """
    t = F.col("offset_min")
    rows = _run_starts(pairs, threshold)
    leading = F.col("ok") & (F.col("fails") == 0)
    per_block = rows.groupBy("stay_id", "block").agg(
        F.max(F.when(~F.col("ok"), 1).otherwise(0)).alias("has_fail"),
        F.max_by(F.when(F.col("ok"), F.col("opened")), "offset_min").alias("tail_open"),
        F.min(F.when(F.col("ok") & ~leading & (t - F.col("opened") >= sustain), t)).alias("hit_inside"),
        F.min(F.when(leading, t)).alias("lead_first"),
        F.collect_list(F.when(leading, t)).alias("lead_minutes"),
        F.count(F.lit(1)).alias("n"),
        F.max("offset_min").alias("block_last"),
        F.min("pf").alias("block_min"),
    )
    stay = Window.partitionBy("stay_id")
    ordered = stay.orderBy("block")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = per_block.withColumn("chain", F.sum("has_fail").over(upto))
    in_chain = (
        Window.partitionBy("stay_id", "chain")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    linked = chained.withColumn("still_open", F.min("tail_open").over(in_chain)).select(
        "*",
        F.lag("still_open").over(ordered).alias("open_before"),
        F.sum("n").over(stay).alias("stay_pairs"),
        F.max("block_last").over(stay).alias("stay_last"),
    )
    lead_start = F.coalesce("open_before", "lead_first")
    lead_hit = F.array_min(F.filter("lead_minutes", lambda m: m - lead_start >= sustain))
    # still_open is NULL when the block's last pair fails
    passes_at_end = (F.col("block_last") == F.col("stay_last")) & F.col("tail_open").isNotNull()
    long_enough = (F.col("still_open") < F.col("stay_last")) | (F.col("stay_pairs") == 1)
    end_hit = F.when(passes_at_end & long_enough, F.col("stay_last"))
    return (
        linked.groupBy("stay_id")
        .agg(
            F.min(F.least(lead_hit, "hit_inside", end_hit)).alias("onset"),
            F.min("block_min").alias("min_pf"),
            F.max("stay_pairs").alias("n_pairs"),
        )
        .select("stay_id", "onset", "min_pf", severity_band(F.col("min_pf")).alias("severity"), "n_pairs")
    )


def sustained_since_failure(
    pairs: DataFrame, threshold: float = MILD_PF, sustain: int = SUSTAIN_MINUTES
) -> DataFrame:
    """Alternative rule: (stay_id, sustained).

    The ratio, rounded to one digit, must be strictly under ``threshold``; the
    clock runs from the last failing pair, or from the stay's first pair.
    """
    rows = pairs.select(
        "stay_id", "block", "offset_min",
        F.coalesce(F.bround("pf", 1) < threshold, F.lit(False)).alias("ok"),
    )
    t = F.col("offset_min")
    rows = rows.withColumn("anchor", F.max(F.when(~F.col("ok"), t)).over(_within_block()))
    per_block = rows.groupBy("stay_id", "block").agg(
        F.max("anchor").alias("block_anchor"),
        F.min("offset_min").alias("block_first"),
        F.max(F.when(F.col("ok"), t - F.col("anchor"))).alias("longest_inside"),
        F.max(F.when(F.col("ok") & F.col("anchor").isNull(), t)).alias("lead_last"),
    )
    borders = per_block.select(
        "*",
        F.max("block_anchor").over(_earlier_blocks()).alias("anchor_before"),
        F.min("block_first").over(Window.partitionBy("stay_id")).alias("stay_first"),
    )
    lead = F.col("lead_last") - F.coalesce("anchor_before", "stay_first")
    longest = F.greatest(F.col("longest_inside"), lead)
    return borders.groupBy("stay_id").agg(
        F.coalesce(F.max(longest) >= sustain, F.lit(False)).alias("sustained")
    )


def pf_onset(
    measurements: DataFrame,
    threshold: float = MILD_PF,
    sustain: int = SUSTAIN_MINUTES,
    **pairing,
) -> DataFrame:
    """Pairing followed by the sustained-onset rule."""
    return sustained_onset(pair_series(measurements, **pairing), threshold, sustain)


def complete_grid(
    measurements: DataFrame,
    first: str = PAO2,
    second: str = FIO2,
    cols: SeriesColumns = LONG,
) -> DataFrame:
    """Group-mean completion of the (minute x analyte) grid of each stay.

    Absent, NULL, NaN and zero values become the stay's mean of the analyte
    (one digit). Stays with at most one row, with one analyte only or with a
    zero mean are dropped. Returns (stay_id, block, offset_min, pao2, fio2).
    """
    minutes = one_row_per_minute(measurements, first, second, cols)

    def present(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c))

    def rounded_mean(c: str) -> Column:
        return F.bround(F.round(F.avg(present(c)), 6), 1)

    means = (
        minutes.groupBy("stay_id")
        .agg(
            (F.count("a") + F.count("b")).alias("n_rows"),
            rounded_mean("a").alias("a_mean"),
            rounded_mean("b").alias("b_mean"),
        )
        .filter((F.col("n_rows") > 1) & (F.col("a_mean") != 0) & (F.col("b_mean") != 0))
    )

    def completed(c: str) -> Column:
        return F.coalesce(F.nullif(present(c), F.lit(0.0)), F.col(f"{c}_mean"))

    return minutes.join(means, "stay_id").select(
        "stay_id", "block", "offset_min", completed("a").alias("pao2"), completed("b").alias("fio2")
    )
