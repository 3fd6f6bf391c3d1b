"""Spark ML estimators with the settings of the study, searches and stacking.

Parameter values are the ones the study used; ``light`` overrides are meant for
small tables. All fitting runs on the distributed rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.learning.forests import GrownForest, can_grow, fit_forest
from breathline.learning.neighbours import out_of_fold_neighbours, vote_share
from breathline.session import cut_lineage, use_checkpoint_dir

SEED = 42
#: rows of a partition that a model is fitted on, where there are more than one a core
FIT_ROWS = 100_000


@dataclass(frozen=True)
class Uniform:
    """A range that ``random_params`` draws from evenly."""

    low: float
    high: float


# Estimator settings of the study.
GBT_CLASSIFIER = {"stepSize": 0.1, "maxIter": 600, "subsamplingRate": 0.8, "maxDepth": 4}
GBT_CLASSIFIER_SLOW = {
    "stepSize": 0.001, "maxIter": 100, "subsamplingRate": 0.8, "maxDepth": 3, "featureSubsetStrategy": "1",
}
GBT_REGRESSOR = {"stepSize": 0.15, "maxIter": 500, "maxDepth": 5}
GBT_REGRESSOR_VALIDATION = {
    "stepSize": 0.18, "maxIter": 100, "maxDepth": 3, "featureSubsetStrategy": "0.8",
}
# no depth limit is meant; 30 is the largest depth that Spark grows
FOREST = {"numTrees": 150, "featureSubsetStrategy": "sqrt", "maxDepth": 30}
TREE = {"impurity": "entropy", "maxDepth": 3, "minInstancesPerNode": 4}
BAGGED_TREES = {"numTrees": 500, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt", "maxDepth": 3, "minInstancesPerNode": 4}
BAGGED_DEEP_TREES = {"numTrees": 500, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "maxDepth": 30}
#: forests in a bag, candidates of a random search
BAGS = 500
SEARCH_DRAWS = 20
LOGISTIC = {"maxIter": 1000, "elasticNetParam": 0.0}
LOGISTIC_C = 0.1
NEIGHBOUR_KS = list(range(50, 65))
GBT_GRID = {
    "maxDepth": [3, 5, 7],
    "maxIter": [1000, 2000, 3000],
    "stepSize": [0.001, 0.01, 0.05, 0.1, 0.15],
}
BOOSTED_WEIGHT_GRID = {
    "maxDepth": [3, 5, 6, 7],
    "maxIter": [200, 500, 700, 1000],
    "stepSize": [0.01, 0.1, 0.15],
    "minCurvature": [1, 2, 3],
}
SVC_GRID = {"C": [0.1, 1, 10, 100, 1000], "gamma": [1, 0.1, 0.01, 0.001, 0.0001]}
SVC_RANGES = {"C": Uniform(0.1, 1e4 + 0.1), "gamma": (1e-6, 1e1)}
FOREST_GRID = {
    "numTrees": [100, 150, 200, 300, 400, 450, 500, 550, 600, 650, 700, 800, 1000],
    "featureSubsetStrategy": ["2", "4", "6", "8"],
}


def gbt_classifier(**light) -> GBTClassifier:
    return GBTClassifier(seed=SEED, checkpointInterval=10, **{**GBT_CLASSIFIER, **light})


def gbt_regressor(**light) -> GBTRegressor:
    return GBTRegressor(seed=SEED, checkpointInterval=10, **{**GBT_REGRESSOR, **light})


def forest_classifier(**light) -> RandomForestClassifier:
    return RandomForestClassifier(seed=SEED, **{**FOREST, **light})


def forest_regressor(**light) -> RandomForestRegressor:
    return RandomForestRegressor(seed=SEED, **{**FOREST, "featureSubsetStrategy": "onethird", **light})


def tree_classifier(**light) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(seed=SEED, **{**TREE, **light})


def bagged_trees(deep: bool = False, **light) -> RandomForestClassifier:
    """Bagging of small trees on row shares, or (``deep``) of full trees on bootstrap samples of all features."""
    settings = {**(BAGGED_DEEP_TREES if deep else BAGGED_TREES), **light}
    return RandomForestClassifier(seed=123, bootstrap=True, impurity="entropy", **settings)


def bagged_regressor(**light) -> RandomForestRegressor:
    return RandomForestRegressor(seed=1, bootstrap=True, **{**BAGGED_DEEP_TREES, **light})


def gaussian_bayes() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def logistic(c: float = LOGISTIC_C, n_rows: int = 1, **light) -> LogisticRegression:
    """Logistic regression with inverse penalty ``c`` over ``n_rows`` rows; Spark's loss is a mean, so it takes 1 / (c n)."""
    return LogisticRegression(**{**LOGISTIC, "regParam": 1.0 / (c * max(1, n_rows)), **light})


def linear_svc(c: float = 1.0, n_rows: int = 1, **light) -> LinearSVC:
    """Linear support vector classifier; the penalty ``c`` is per row in Spark."""
    return LinearSVC(regParam=1.0 / (c * max(1, n_rows)), **light)


def feature_pipeline(
    columns: Sequence[str],
    estimator: Estimator,
    impute: bool = False,
    scale: tuple[float, float] | None = (0.0, 1.0),
) -> Pipeline:
    """Impute, assemble, scale and fit in one pipeline, so test rows never shape the scaling."""
    stages: list[Estimator] = []
    inputs = list(columns)
    if impute:
        filled = [f"{c}__filled" for c in inputs]
        stages.append(Imputer(strategy="mean", inputCols=inputs, outputCols=filled))
        inputs = filled
    raw = "features" if scale is None else "raw_features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw))
    if scale is not None:
        stages.append(MinMaxScaler(min=scale[0], max=scale[1], inputCol=raw, outputCol="features"))
    return Pipeline(stages=[*stages, estimator])


def fit(estimator: Estimator, train: DataFrame) -> Model | GrownForest:
    """Fit on rows kept in memory or on disk, as fitting reads them many times.

    They are dealt evenly first: texts parsed from a file of one row group would
    leave all rows, and with them every pass of the fit, to one task. Boosted
    trees cut their lineage in the checkpoint folder. A pipeline that ends with
    a forest of whole trees is fitted by ``forests.fit_forest``.
    """
    use_checkpoint_dir(train.sparkSession)
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // FIT_ROWS))
    kept = train.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        grown = fit_forest(estimator, kept) if isinstance(estimator, Pipeline) and can_grow(estimator.getStages()[-1]) else None
        return grown or estimator.fit(kept)
    finally:
        kept.unpersist()


def score(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Class and probability of label 1: (keep..., score, prediction)."""
    if isinstance(model, GrownForest):
        return model.score(df, keep)
    out = model.transform(df)
    if "probability" in out.columns:
        value = vector_to_array(F.col("probability"))[1]
    elif "rawPrediction" in out.columns:
        value = vector_to_array(F.col("rawPrediction"))[1]
    else:
        value = F.col("prediction")
    return out.select(*keep, value.alias("score"), F.col("prediction").cast("double").alias("prediction"))


def param_grid(estimator: Estimator, grid: Mapping[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def random_draws(space: Mapping[str, Sequence | tuple[float, float]], n: int, seed: int = SEED) -> list[dict]:
    """``n`` choices: lists are drawn from evenly, pairs log-uniformly, ranges (see ``Uniform``) uniformly."""
    rng = random.Random(seed)

    def draw(options):
        if isinstance(options, Uniform):
            return rng.uniform(options.low, options.high)
        if isinstance(options, tuple):
            low, high = options
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.choice(list(options))

    return [{k: draw(v) for k, v in space.items()} for _ in range(n)]


def random_params(estimator: Estimator, space: Mapping[str, Sequence | tuple[float, float]], n: int, seed: int = SEED) -> list[dict]:
    """``random_draws`` as parameter maps of an estimator."""
    return [{estimator.getParam(k): v for k, v in x.items()} for x in random_draws(space, n, seed)]


def cross_validate(
    estimator: Estimator,
    params: Sequence[dict],
    df: DataFrame,
    fold_col: str,
    folds: int,
    evaluator: Evaluator | None = None,
    parallelism: int = 2,
) -> CrossValidatorModel:
    """Cross validation over given folds, best parameters refitted on all rows."""
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=list(params) or [{}],
        evaluator=evaluator or BinaryClassificationEvaluator(metricName="areaUnderROC"),
        numFolds=folds,
        foldCol=fold_col,
        parallelism=parallelism,
    )
    return fit(search, df)


def accuracy() -> Evaluator:
    return MulticlassClassificationEvaluator(metricName="accuracy")


def search_table(df: DataFrame, model: CrossValidatorModel) -> DataFrame:
    """(candidate, params, mean, sd, best): one row per parameter map."""
    larger = model.getEvaluator().isLargerBetter()
    best = (max if larger else min)(range(len(model.avgMetrics)), key=model.avgMetrics.__getitem__)
    rows = [
        (
            i,
            ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)),
            float(model.avgMetrics[i]),
            float(model.stdMetrics[i]),
            i == best,
        )
        for i, m in enumerate(model.getEstimatorParamMaps())
    ]
    return df.sparkSession.createDataFrame(rows, "candidate int, params string, mean double, sd double, best boolean")


def tree_summary(df: DataFrame, model: Model) -> DataFrame:
    """(tree, leaves, height, nodes) of a fitted tree model."""
    if isinstance(model, GrownForest):
        return model.summary()
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    trees = getattr(last, "trees", None) or [last]
    rows = [(i, (t.numNodes + 1) // 2, t.depth + 1, t.numNodes) for i, t in enumerate(trees)]
    return df.sparkSession.createDataFrame(rows, "tree int, leaves int, height int, nodes int")


def split_listing(model: Model) -> str:
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    return last.toDebugString


def feature_weights(df: DataFrame, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """(feature, importance) of a fitted tree pipeline."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(w)) for c, w in zip(columns, weights, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def out_of_fold_scores(
    df: DataFrame, pipeline: Pipeline, fold_col: str, folds: int, keep: Sequence[str]
) -> DataFrame:
    """Every row scored by a model fitted on the other folds."""
    parts = []
    for i in range(folds):
        model = fit(pipeline, df.filter(F.col(fold_col) != i))
        parts.append(score(model, df.filter(F.col(fold_col) == i), keep))
    return reduce(DataFrame.unionByName, parts)


def stacked_scores(
    df: DataFrame,
    id_col: str,
    vector: str,
    columns: Sequence[str],
    fold_col: str,
    folds: int,
    k: int = 50,
    forest: Mapping | None = None,
) -> tuple[DataFrame, Model]:
    """Stacking: neighbours, forest and naive Bayes out of fold, logistic regression on top.

    Returns the scored rows (id, label, score, prediction) and the meta model.
    """
    keep = [id_col]
    forest_part = out_of_fold_scores(
        df, feature_pipeline(columns, forest_classifier(**(forest or {}))), fold_col, folds, keep
    ).select(id_col, F.col("score").alias("forest"))
    bayes_part = out_of_fold_scores(
        df, feature_pipeline(columns, gaussian_bayes(), scale=None), fold_col, folds, keep
    ).select(id_col, F.col("score").alias("bayes"))
    near = vote_share(out_of_fold_neighbours(df, id_col, vector, "label", fold_col, k), k)
    near = near.select(F.col("query_id").alias(id_col), F.col("score").alias("near"))
    # counted, fitted on and scored: the parts are computed once
    base = cut_lineage(df.select(id_col, "label").join(forest_part, id_col).join(bayes_part, id_col).join(near, id_col))
    meta = fit(feature_pipeline(["near", "forest", "bayes"], logistic(n_rows=base.count()), scale=None), base)
    return score(meta, base, [id_col, "label"]), meta
