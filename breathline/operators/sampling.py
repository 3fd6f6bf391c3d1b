"""Shuffles, splits, folds, label codes, bootstrap samples and projections."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a repeatable random order (a hash of the key, not a per-task generator)."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return tied.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key), "_tie").drop("_tie")


def hash_share(key: Column, seed: int = 0) -> Column:
    """Repeatable uniform number in [0, 1) per key: the first 32 bits of an MD5, which other engines have too."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def train_test(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 123) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: no shuffle, and a key is always on the same side."""
    share = hash_share(F.col(key), seed)
    return df.filter(share >= test_share), df.filter(share < test_share)


def stratified_train_test(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 1, buckets: int = 1 << 16
) -> tuple[DataFrame, DataFrame]:
    """Split in which the test part of each class has exactly round(test_share * n) rows, those of smallest hash.

    Rows are counted per class and hash bucket; only the one bucket of a class
    that holds the cut is ranked (by hash, then key). Keys are unique.
    """
    share = hash_share(F.col(key), seed)
    rows = df.withColumn("_share", share).withColumn("_bucket", F.floor(F.col("_share") * buckets).cast("int"))
    counts = rows.groupBy(F.col(label).alias("_label"), "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_bucket")
    counts = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn(
        "_wanted", F.round(F.sum("_n").over(Window.partitionBy("_label")) * test_share)
    )
    cut = counts.where("_before < _wanted AND _before + _n >= _wanted").select(
        "_label", F.col("_bucket").alias("_cut"), (F.col("_wanted") - F.col("_before")).alias("_take")
    )
    placed = rows.join(cut, rows[label].eqNullSafe(cut["_label"]), "left")
    edge = placed.where("_bucket = _cut").withColumn("_rank", F.row_number().over(Window.partitionBy("_label").orderBy("_share", key)))
    columns = df.columns
    train = placed.where("_cut IS NULL OR _bucket > _cut").select(columns).union(edge.where("_rank > _take").select(columns))
    test = placed.where("_bucket < _cut").select(columns).union(edge.where("_rank <= _take").select(columns))
    return train, test


def fold_number(key: Column, folds: int = 5) -> Column:
    """Fold 0..folds-1 from an integer key."""
    return F.pmod(key.cast("bigint"), F.lit(folds)).cast("int")


def hashed_fold(key: Column, folds: int = 5, seed: int = 0) -> Column:
    """Fold of a key whose integers are not evenly spread."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def encode_labels(df: DataFrame, label: str, name: str = "label_code") -> DataFrame:
    """Codes 0, 1, ... of the class labels in ascending order (few distinct labels)."""
    classes = df.filter(F.col(label).isNotNull()).select(label).distinct()
    codes = classes.withColumn(name, (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(codes, label, "left")


def poisson_count(share: Column, rate: float) -> Column:
    """Count whose distribution is Poisson if ``share`` is uniform in [0, 1)."""
    term, total, out = math.exp(-rate), 0.0, F.lit(0)
    for count in range(40):
        total += term
        out = out + F.when(share >= total, 1).otherwise(0)
        term *= rate / (count + 1)
    return out


def bootstrap(df: DataFrame, key: str, share: float = 1.0, seed: int = 1) -> DataFrame:
    """Sample with replacement: each row as often as a Poisson count of its key's hash says, whatever the layout."""
    count = poisson_count(hash_share(F.col(key), seed), share)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), count))).where("_copy > 0").drop("_copy")


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Named columns as one feature vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)


def principal_components(df: DataFrame, features: str = "features", k: int = 2, output: str = "components") -> DataFrame:
    return PCA(k=k, inputCol=features, outputCol=output).fit(df).transform(df)
