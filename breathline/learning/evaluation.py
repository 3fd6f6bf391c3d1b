"""Evaluation of scored rows as distributed aggregates.

Scores are first counted per distinct value (map-side combine). Cumulative
counts come from ``running_totals``, which never orders all scores in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from breathline.functions.numeric import safe_ratio
from breathline.operators.ordering import running_totals
from breathline.session import cut_lineage

GRID_POINTS = 100


def score_counts(scored: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """(keys, score, pos, neg): labels counted per distinct score."""
    y = F.col(label)
    return scored.groupBy(*keys, score).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y != 1, 1)).alias("neg")
    )


def _cumulative(scored: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Counts per score with the positives and negatives at or above it, and the totals."""
    keys = list(keys)
    # written once: the scores may come from a model, and the counts are read several times
    counts = cut_lineage(score_counts(scored, keys, label, score))
    curve = running_totals(counts, score, {"pos": "tp", "neg": "fp"}, keys, descending=True)
    sums = counts.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if keys:
        return curve.join(sums, keys)
    return curve.select("*", sums.select(F.struct("*").alias("s")).scalar().alias("_s")).select(
        *curve.columns, "_s.all_pos", "_s.all_neg"
    )


def roc_points(
    scored: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """ROC points, one per distinct threshold: (keys, threshold, tp, fp, tpr, fpr)."""
    rows = _cumulative(scored, keys, label, score)
    return rows.select(
        *keys,
        F.col(score).alias("threshold"),
        "tp",
        "fp",
        "all_pos",
        "all_neg",
        safe_ratio(F.col("tp"), F.col("all_pos")).alias("tpr"),
        safe_ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
    )


def auc_and_ks(
    scored: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Area under the ROC curve (ties count half) and the largest tpr - fpr."""
    rows = _cumulative(scored, keys, label, score)
    pairs_won = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)
    gap = safe_ratio(F.col("tp"), F.col("all_pos")) - safe_ratio(F.col("fp"), F.col("all_neg"))
    return rows.groupBy(*keys).agg(
        safe_ratio(
            F.sum(pairs_won), F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
        ).alias("auc"),
        F.greatest(F.lit(0.0), F.max(gap)).alias("ks"),
    )


def confusion_matrix(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """Counts per (label, prediction)."""
    return scored.groupBy(*keys, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def binary_counts(label: Column, prediction: Column) -> list[Column]:
    def cell(y: int, p: int, name: str) -> Column:
        return F.count(F.when((label == y) & (prediction == p), 1)).alias(name)

    return [cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp")]


def classification_metrics(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """Confusion cells and the ratios derived from them, per key."""
    cells = scored.groupBy(*keys).agg(*binary_counts(F.col(label), F.col(prediction)))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select(
        *keys, "tn", "fp", "fn", "tp",
        safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        safe_ratio(tp, tp + fn).alias("sensitivity"),
        safe_ratio(tn, tn + fp).alias("specificity"),
        safe_ratio(tp, tp + fp).alias("ppv"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_ratio(tp, tp + fn).alias("tpr"),
        safe_ratio(fp, fp + tn).alias("fpr"),
    )


def regression_metrics(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """MSE, RMSE, MAE and R squared; on probabilities the MSE is the Brier score."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    base = scored.groupBy(*keys).agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("_var"),
    )
    return base.select(
        *keys, "mse", F.sqrt("mse").alias("rmse"), "mae",
        (F.lit(1.0) - safe_ratio(F.col("mse"), F.col("_var"))).alias("r2"),
    )


def roc_on_grid(points: DataFrame, fold: str, grid: int = GRID_POINTS) -> DataFrame:
    """tpr of each fold's curve interpolated at ``grid`` equally spaced fpr values.

    ``points`` come from ``roc_points``. They are first reduced to the first
    and last of each grid cell, so at most one row per fold and grid value is
    ordered, however many thresholds there are. Cells are found in integers.
    Where several tpr share one fpr, the largest counts at that fpr.
    """
    steps = grid - 1
    scaled = F.col("fp") * F.lit(steps)
    on_grid = scaled % F.col("all_neg") == 0
    # along a curve tp never falls while fp rises, so both extremes belong to one point
    cells = (
        points.filter((F.col("all_neg") > 0) & (F.col("all_pos") > 0))
        .withColumn("g", ((scaled - scaled % F.col("all_neg")) / F.col("all_neg")).cast("int"))
        .groupBy(fold, "g")
        .agg(
            *[F.max(F.when(on_grid, F.col(c))).alias(f"exact_{c}") for c in ("fp", "tp")],
            *[F.min(F.when(~on_grid, F.col(c))).alias(f"inside_{c}") for c in ("fp", "tp")],
            *[F.min(c).alias(f"first_{c}") for c in ("fp", "tp")],
            *[F.max(c).alias(f"last_{c}") for c in ("fp", "tp")],
        )
    )
    sizes = points.groupBy(fold).agg(F.max("all_pos").alias("all_pos"), F.max("all_neg").alias("all_neg"))
    spine = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("g"))
    rows = spine.join(cells, [fold, "g"], "left")
    before = Window.partitionBy(fold).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(fold).orderBy("g").rowsBetween(1, Window.unboundedFollowing)

    def low(c: str) -> Column:
        held = F.last(f"last_{c}", ignorenulls=True).over(before)
        return F.coalesce(f"exact_{c}", held, F.lit(0)).alias(f"low_{c}")

    def high(c: str) -> Column:
        return F.coalesce(f"inside_{c}", F.first(f"first_{c}", ignorenulls=True).over(after)).alias(f"high_{c}")

    bracket = rows.select(
        fold, "g", "all_pos", "all_neg", (F.col("g") / F.lit(steps)).alias("x"),
        low("fp"), low("tp"), high("fp"), high("tp"),
    )
    part = safe_ratio(
        F.col("x") * F.col("all_neg") - F.col("low_fp"), F.col("high_fp") - F.col("low_fp")
    )
    rise = F.coalesce(part * (F.col("high_tp") - F.col("low_tp")), F.lit(0.0))
    value = safe_ratio(F.col("low_tp") + rise, F.col("all_pos"))
    return bracket.select(fold, "g", "x", F.when(F.col("g") == 0, 0.0).otherwise(value).alias("tpr"))


def mean_roc(points: DataFrame, fold: str = "fold", grid: int = GRID_POINTS) -> DataFrame:
    """Mean curve over folds with a band of one population deviation, cut to [0, 1]."""
    curves = roc_on_grid(points, fold, grid)
    mean = F.avg("tpr")
    band = curves.groupBy("g", "x").agg(mean.alias("m"), F.stddev_pop("tpr").alias("sd"))
    m = F.when(F.col("g") == grid - 1, F.lit(1.0)).otherwise(F.col("m"))
    return band.select(
        "g", F.col("x").alias("fpr"), m.alias("tpr"),
        F.greatest(m - F.col("sd"), F.lit(0.0)).alias("lower"),
        F.least(m + F.col("sd"), F.lit(1.0)).alias("upper"),
    )


def mean_auc(mean_curve: DataFrame) -> DataFrame:
    """Trapezoid area under the mean curve (one row; the curve has a fixed grid)."""
    w = Window.partitionBy(F.lit(0)).orderBy("g")
    part = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return mean_curve.select(part.alias("part")).agg(F.sum("part").alias("mean_auc"))


def compare_models(scored: DataFrame, model: str = "model", cutoff: float = 0.5) -> DataFrame:
    """One row per model: AUC, KS, accuracy, sensitivity and specificity at a cutoff."""
    curve = auc_and_ks(scored, [model])
    predicted = scored.withColumn("prediction", (F.col("score") >= cutoff).cast("int"))
    cells = classification_metrics(predicted, keys=[model]).select(
        model, "accuracy", "sensitivity", "specificity"
    )
    return curve.join(cells, model)
