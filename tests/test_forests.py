"""Forests grown tree by tree against the estimators whose settings they follow."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from breathline.learning import models
from breathline.learning.forest_bags import GrownTrees, grow_trees
from breathline.learning.forests import GrownForest, bin_ends, can_grow, features_each


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 4)), 2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(1500) < 0.15)).astype(int)
    rows = [(i, *map(float, v), float(i % 3), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, label int").cache()


COLUMNS = ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("estimator", [models.forest_classifier, models.bagged_regressor])
def test_scores_and_sizes_are_like_those_of_the_estimator(table, estimator):
    pipeline = models.feature_pipeline(COLUMNS, estimator(numTrees=40))
    train, held = table.where("id % 5 <> 0"), table.where("id % 5 = 0")
    ours, theirs = models.fit(pipeline, train), pipeline.fit(train)
    assert isinstance(ours, GrownForest) and isinstance(theirs, PipelineModel)
    a, b = (models.score(m, held, ["id", "label"]).toPandas().sort_values("id") for m in (ours, theirs))
    assert list(a.columns) == list(b.columns) and (a.dtypes == b.dtypes).all() and (a.id.to_numpy() == b.id.to_numpy()).all()
    assert np.corrcoef(a.score, b.score)[0, 1] > 0.93 and abs((a.score - b.score).mean()) < 0.03
    assert abs(((a.score > 0.5) == a.label).mean() - ((b.score > 0.5) == b.label).mean()) < 0.05
    x, y = (models.tree_summary(table, m).toPandas() for m in (ours, theirs))
    assert sorted(x.tree) == list(range(40)) and list(x.columns) == list(y.columns) and (x.dtypes == y.dtypes).all()
    assert (x.nodes == 2 * x.leaves - 1).all() and abs(x.nodes.mean() / y.nodes.mean() - 1) < 0.1 and abs(x.height.mean() / y.height.mean() - 1) < 0.15
    again = models.score(ours, held, ["id"]).toPandas().sort_values("id")
    through = ours.transform(held).toPandas().sort_values("id")
    assert np.array_equal(again.prediction, through.prediction)


def test_trees_do_not_depend_on_partitions(table):
    pipeline = models.feature_pipeline(COLUMNS, models.forest_classifier(numTrees=5))
    one, other = (models.score(models.fit(pipeline, rows), table, ["id"]).orderBy("id").toPandas() for rows in (table, table.orderBy(F.desc("id")).coalesce(1)))
    assert np.array_equal(one.score, other.score)


def test_no_tree_of_a_summary_reaches_the_driver(table, monkeypatch):
    fitted = models.fit(models.feature_pipeline(COLUMNS, models.forest_classifier(numTrees=5)), table)
    assert models.tree_summary(table, fitted).columns == ["tree", "leaves", "height", "nodes"]
    assert "packed" in fitted.trees.columns and not any(isinstance(v, GrownTrees) for v in vars(fitted).values())


def test_what_is_left_to_the_estimators(spark, table):
    assert not can_grow(models.bagged_trees()) and not can_grow(models.tree_classifier()) and not can_grow(models.forest_regressor())
    assert not can_grow(models.forest_classifier(minInstancesPerNode=2)) and can_grow(models.forest_classifier()) and can_grow(models.bagged_regressor())
    three = table.withColumn("label", F.col("id") % 3)
    pipeline = models.feature_pipeline(COLUMNS, models.forest_classifier(numTrees=3, maxDepth=3))
    assert isinstance(models.fit(pipeline, three), PipelineModel)
    for bad in (table.withColumn("a", F.when(F.col("id") != 7, F.col("a"))), table.withColumn("label", F.when(F.col("id") != 7, F.col("label"))), table.where("false")):
        with pytest.raises(Exception):  # noqa: B017
            models.fit(pipeline, bad)
    assert features_each("sqrt", 6, 150, True) == 3 and features_each("all", 6, 500, False) == 6


def test_few_values_keep_a_bin_each(spark):
    rows = spark.range(5000).select(F.array((F.col("id") % 7).cast("double"), F.when(F.col("id") == 3, 1.0).otherwise(0.0), F.col("id").cast("double")).alias("_features"))
    few, rare, many = bin_ends(rows, 3, 32)
    assert few.tolist() == [0, 1, 2, 3, 4, 5] and rare.tolist() == [0.0] and len(many) == 31
    assert np.diff(np.searchsorted(many, np.arange(5000)).tolist()).sum() == 31 and np.bincount(np.searchsorted(many, np.arange(5000))).max() < 200


def test_sibling_leaves_of_one_class_are_one():
    rng = np.random.default_rng(3)
    bins, labels = rng.integers(0, 20, (400, 2)).astype(np.uint8), rng.integers(0, 2, 400).astype(float)
    whole = grow_trees(bins, labels, np.ones((1, 400), int), 20, 2)
    cut = whole.pruned()
    assert np.array_equal(whole.leaf_shares(bins) > 0.5, cut.leaf_shares(bins) > 0.5) and (cut.child >= 0).sum() < (whole.child >= 0).sum()
    inner = np.flatnonzero(cut.child >= 0)
    low = cut.child[inner]
    ends = (cut.child[low] < 0) & (cut.child[low + 1] < 0)
    assert ((cut.share[low] > 0.5) != (cut.share[low + 1] > 0.5))[ends].all() and cut.height() <= whole.height()
