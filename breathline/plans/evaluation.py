"""From a table with gaps to held-out scores: impute, scale and fit on the other folds, score the fold left out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.learning import models
from breathline.operators import imputation


def train_and_score(
    train: DataFrame, test: DataFrame, columns: Sequence[str], estimator: Estimator, keep: Sequence[str]
) -> DataFrame:
    """(keep..., score, prediction) of the test rows; means, ranges and the model come from the training rows alone."""
    means = imputation.fit_means(train, columns)
    filled = imputation.impute_means(train, means, columns)
    ranges = imputation.fit_ranges(filled, columns)
    fitted = models.fit(
        models.feature_pipeline(columns, estimator, scale=None), imputation.scale_min_max(filled, ranges, columns)
    )
    rows = imputation.scale_min_max(imputation.impute_means(test, means, columns), ranges, columns)
    return models.score(fitted, rows, keep)


def held_out_scores(
    df: DataFrame, fold: str, folds: int, columns: Sequence[str], estimator: Estimator, keep: Sequence[str]
) -> DataFrame:
    """Every row scored once, by the path fitted on the other folds."""
    parts = [
        train_and_score(df.filter(F.col(fold) != i), df.filter(F.col(fold) == i), columns, estimator, keep) for i in range(folds)
    ]
    return reduce(DataFrame.unionByName, parts)
