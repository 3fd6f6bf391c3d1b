"""Forests of a few hundred deep trees: the rows reach every task as bins, a byte each, and each tree is grown whole in one task.

Growing level by level over the cluster reads all rows again for every level
and holds all trees on the driver. Here a tree costs one task some passes over
its own rows, which shrink as nodes become pure.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from breathline.learning.forest_bags import GrownTrees, grow_trees
from breathline.session import cut_lineage

#: rows that are scored at once
SCORED_ROWS = 20_000


def features_each(strategy: str, width: int, trees: int, classes: bool) -> int | None:
    """How many features a node looks at; None for a strategy that is not known here."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    share = {"all": width, "sqrt": np.sqrt(width), "onethird": width / 3}.get(strategy)
    return None if share is None else int(np.ceil(share))


def can_grow(estimator) -> bool:
    """Whether the settings are those that ``fit_forest`` follows: bootstraps of all rows, no floor but purity, Gini gain.

    The variance of labels 0 and 1 is half their Gini impurity, so bags of regression trees on all features split alike.
    """
    if not isinstance(estimator, RandomForestClassifier | RandomForestRegressor):
        return False
    get = estimator.getOrDefault
    classes = isinstance(estimator, RandomForestClassifier)
    return (
        get("impurity") == ("gini" if classes else "variance") and (classes or get("featureSubsetStrategy") == "all") and get("featureSubsetStrategy") in ("auto", "all", "sqrt", "onethird")
        and get("bootstrap") and get("subsamplingRate") == 1.0 and get("minInstancesPerNode") == 1 and get("minInfoGain") == 0.0
        and get("minWeightFractionPerNode") == 0.0 and not estimator.isDefined("weightCol") and not (classes and estimator.isDefined("thresholds"))
        and get("maxBins") <= 256
    )


class GrownForest:
    """A fitted forest: the stages before it, the ends of its bins, and one row a tree (tree, leaves, height, nodes, packed)."""

    def __init__(self, stages: PipelineModel, features: str, ends: list[np.ndarray], trees: DataFrame, classes: bool):
        self.stages, self.features, self.ends, self.trees, self.classes = stages, features, ends, trees, classes

    def summary(self) -> DataFrame:
        """(tree, leaves, height, nodes); no tree reaches the driver."""
        return self.trees.select("tree", "leaves", "height", "nodes")

    def transform(self, df: DataFrame) -> DataFrame:
        """The columns of ``df`` with ``prediction`` and, of classes, ``probability``."""
        out = self.score(df, df.columns)
        both = F.array(1 - F.col("score"), F.col("score"))
        return (out.withColumn("probability", array_to_vector(both)) if self.classes else out).drop("score")

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., score, prediction): the mean share of label 1 over the trees, and the class, or again the mean."""
        packed = self.trees.orderBy("tree").select("packed").toArrow().column("packed").to_pylist()
        ends, classes, keep = self.ends, self.classes, list(keep)
        rows = self.stages.transform(df).select(*keep, vector_to_array(F.col(self.features)).alias("_features"))
        schema = StructType([*rows.select(*keep).schema.fields, StructField("score", DoubleType()), StructField("prediction", DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = [pickle.loads(t) for t in packed]
            for batch in batches:
                for a in range(0, batch.num_rows, SCORED_ROWS):
                    part = batch.slice(a, SCORED_ROWS)
                    bins = binned(part.column(part.num_columns - 1), ends)
                    share = np.zeros(len(bins))
                    for tree in trees:
                        share += tree.leaf_shares(bins)[0]
                    share /= len(trees)
                    prediction = (share > 0.5).astype(float) if classes else share
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(share), pa.array(prediction)], names=schema.names)

        return rows.mapInArrow(run, schema)


def binned(vectors: pa.Array, ends: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: a byte each, (rows, features); bin b ends with the value ``ends[feature][b]``."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(ends))
    return np.column_stack([np.searchsorted(e, values[:, j]) for j, e in enumerate(ends)]).astype(np.uint8) if ends else np.zeros((len(vectors), 0), np.uint8)


def bin_ends(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Ends of at most ``bins`` parts of about equal rows for each value of the array ``_features``, over all rows.

    A feature of few values keeps each of them.
    """
    probs = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col("_features")[j], probs, 10_000) for j in range(width)]).first()
    ends = [sorted(set(own or [])) for own in found]
    tied = [j for j in range(width) if len(ends[j]) < bins - 1]
    if tied:
        values = rows.select(F.posexplode("_features").alias("j", "x")).where(F.col("j").isin(tied)).distinct()
        few = [r.j for r in values.groupBy("j").count().where(F.col("count") <= bins).collect()]
        kept = values.where(F.col("j").isin(few)).collect() if few else []
        for j in few:
            ends[j] = sorted(r.x for r in kept if r.j == j)[:-1]
    return [np.array(e, float) for e in ends]


def fit_forest(pipeline: Pipeline, train: DataFrame) -> GrownForest | None:
    """The forest at the end of ``pipeline``, for labels 0 and 1; None where there is a row without one of them, or no row.

    Settings and rules are those of the estimator: each tree draws every row by
    a Poisson weight of mean 1, a node looks at its own random features and is a
    leaf if none of them splits it, features have ``maxBins`` bins, sibling
    leaves of one class are one leaf. Draws depend on seed, tree and the place of
    a row in the order of bins and label: given the ends of the bins, neither partitions nor
    cores change a tree.
    """
    *before, estimator = pipeline.getStages()
    get = estimator.getOrDefault
    classes = isinstance(estimator, RandomForestClassifier)
    stages = Pipeline(stages=before).fit(train)
    rows = stages.transform(train).select(vector_to_array(F.col(get("featuresCol"))).alias("_features"), F.col(get("labelCol")).cast("double").alias("label"))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label").isin(0.0, 1.0)).alias("labelled"), F.max(F.size("_features")).alias("width")).first()
    if not seen.n or seen.labelled < seen.n:
        return None
    width, trees, depth, seed = seen.width, get("numTrees"), get("maxDepth"), get("seed") & 0xFFFFFFFF
    each = features_each(get("featureSubsetStrategy"), width, trees, classes)
    ends = bin_ends(rows, width, get("maxBins"))

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.column_stack([binned(batch.column(0), ends), batch.column(1).to_numpy().astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary())], names=["bins"])

    held = b"".join(rows.mapInArrow(bin_rows, "bins binary").toArrow().column("bins").to_pylist())
    table = np.frombuffer(held, np.uint8).reshape(-1, width + 1)
    table = table[np.argsort(table.view(f"S{width + 1}").ravel(), kind="stable")]
    count = max((len(e) for e in ends), default=0) + 1
    spark = train.sparkSession
    parts = min(trees, 4 * spark.sparkContext.defaultParallelism)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, labels = np.ascontiguousarray(table[:, :-1]), table[:, -1].astype(float)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for t in range(part, trees, parts):
                    weights = np.random.default_rng([seed, t, 1]).poisson(1.0, (1, len(labels)))
                    grown = grow_trees(bins, labels, weights, count, each, depth, seed=[seed, t], look_on=False)
                    if classes:
                        grown = grown.pruned()
                    internal = int((grown.child >= 0).sum())
                    small = GrownTrees(grown.feature.astype(np.uint16), grown.cut.astype(np.uint16), grown.child.astype(np.int32), grown.share, 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t], pa.int32()), pa.array([internal + 1], pa.int32()), pa.array([grown.height()], pa.int32()), pa.array([2 * internal + 1], pa.int32()), pa.array([pickle.dumps(small, 5)], pa.binary())],
                        names=["tree", "leaves", "height", "nodes", "packed"],
                    )

    grown = cut_lineage(spark.range(0, parts, 1, parts).mapInArrow(grow, "tree int, leaves int, height int, nodes int, packed binary"))
    return GrownForest(stages, get("featuresCol"), ends, grown, classes)
