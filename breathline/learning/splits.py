"""Exact split search and additive regression trees, one aggregate per level.

The rows stay distributed: per round Spark counts rows and sums residuals per
(node, feature, value), takes running totals in value order and returns only
the best split of each node. The driver holds the tree, never rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from breathline.functions.numeric import safe_ratio
from breathline.operators.ordering import quantile_splits, running_totals, with_bucket
from breathline.session import cut_lineage


@dataclass(frozen=True)
class Stump:
    split: float
    left: float
    right: float

    def column(self, x: Column) -> Column:
        return F.when(x < self.split, self.left).otherwise(self.right)


def squared_error(n: Column, s: Column, q: Column) -> Column:
    """Sum of squared deviations from count, sum and sum of squares."""
    return q - safe_ratio(s * s, n)


def split_errors(per_value: DataFrame, cut_points: Sequence[float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Error of every midpoint split of (keys, x, n, s, q) rows, one row per x.

    ``n``, ``s`` and ``q`` are the count, sum and sum of squares of the target
    at ``x``. Adds left/right counts, means and ``sse``; ``split`` lies halfway
    to the next value and is NULL for the largest x.
    """
    keys = list(keys)
    left = running_totals(per_value, "x", {"n": "ln", "s": "ls", "q": "lq"}, keys, splits=cut_points)
    totals = per_value.groupBy(*keys).agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    if keys:
        joined = left.join(totals, keys)
    else:
        joined = left.select("*", totals.select(F.struct("*").alias("t")).scalar().alias("_t")).select(
            *left.columns, "_t.*"
        )
    rn, rs, rq = (F.col(f"t{c}") - F.col(f"l{c}") for c in "nsq")
    ln, ls, lq = (F.col(f"l{c}") for c in "nsq")
    return joined.select(
        *keys, "x", "ln",
        rn.alias("rn"),
        F.col("tn").alias("n_total"),
        squared_error(F.col("tn"), F.col("ts"), F.col("tq")).alias("parent_sse"),
        safe_ratio(ls, ln).alias("left_mean"),
        safe_ratio(rs, rn).alias("right_mean"),
        (squared_error(ln, ls, lq) + F.coalesce(squared_error(rn, rs, rq), F.lit(0.0))).alias("sse"),
    )


def next_values(per_value: DataFrame, x: str = "x") -> DataFrame:
    """(x, next_x) of the distinct values, by linking each range bucket to the next one."""
    values = per_value.select(x).distinct()
    bucketed = with_bucket(values, x, quantile_splits(values, x))
    inside = bucketed.withColumn("next_x", F.lead(x).over(Window.partitionBy("bucket").orderBy(x)))
    heads = inside.groupBy("bucket").agg(F.min(x).alias("head"))
    links = heads.select("bucket", F.lead("head").over(Window.partitionBy(F.lit(0)).orderBy("bucket")).alias("next_head"))
    return inside.join(links, "bucket").select(x, F.coalesce("next_x", "next_head").alias("next_x"))


def per_value_sums(df: DataFrame, x: str, y: str) -> DataFrame:
    """Count, sum and sum of squares of ``y`` per distinct ``x``."""
    target = F.col(y).cast("double")
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"), F.sum(target * target).alias("q"))
    )


def stump_candidates(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every midpoint split of one feature: (split, left_mean, right_mean, sse)."""
    sums = cut_lineage(per_value_sums(df, x, y))
    errors = split_errors(sums).join(next_values(sums), "x").filter(F.col("next_x").isNotNull())
    return errors.select(
        ((F.col("x") + F.col("next_x")) / 2).alias("split"), "left_mean", "right_mean", "sse"
    )


def best_stump(df: DataFrame, x: str, y: str) -> DataFrame:
    """The split of least squared error (the smallest split among equals), one row."""
    best = F.min(F.struct("sse", "split", "left_mean", "right_mean"))
    return stump_candidates(df, x, y).agg(best.alias("b")).select(
        "b.split", "b.left_mean", "b.right_mean", "b.sse"
    )


def boosted_stumps(df: DataFrame, x: str, y: str, error: float, max_rounds: int | None = None) -> list[Stump]:
    """Additive stumps on one feature until the residual error is under ``error``.

    The end also comes when no split lowers the error any more, since all later
    rounds would repeat it; ``max_rounds`` is only a limit if it is given.

    The residual of a row depends on its x alone, so all rounds work on the
    per-value sums: sum and sum of squares move by the fitted value.
    """
    sums = cut_lineage(per_value_sums(df, x, y))
    base = cut_lineage(sums.join(next_values(sums), "x"))
    cuts = quantile_splits(base, "x")
    stumps: list[Stump] = []
    fitted: Column = F.lit(0.0)
    before = float("inf")
    while max_rounds is None or len(stumps) < max_rounds:
        current = base.select(
            "x", "next_x", "n",
            (F.col("s") - F.col("n") * fitted).alias("s"),
            (F.col("q") - 2 * fitted * F.col("s") + F.col("n") * fitted * fitted).alias("q"),
        )
        rows = split_errors(current.drop("next_x"), cuts).join(base.select("x", "next_x"), "x")
        split = (F.col("x") + F.col("next_x")) / 2
        found = (
            rows.filter(F.col("next_x").isNotNull())
            .agg(F.min(F.struct("sse", split.alias("split"), "left_mean", "right_mean")).alias("b"))
            .select("b.*")
            .first()
        )
        if found.sse is None or found.sse >= before * (1 - 1e-12):
            break
        before = found.sse
        stump = Stump(found.split, found.left_mean, found.right_mean)
        stumps.append(stump)
        fitted = fitted + stump.column(F.col("x"))
        if found.sse < error:
            break
    return stumps


def predict_stumps(stumps: Sequence[Stump], x: Column) -> Column:
    out: Column = F.lit(0.0)
    for stump in stumps:
        out = out + stump.column(x)
    return out


def feature_value_sums(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, x, n, s, q) over all features: one scan, counts combined map-side."""
    y = F.col(target).cast("double")
    long = df.select(
        *keys, y.alias("y"), *[F.col(f).cast("double").alias(f) for f in features]
    ).unpivot([*keys, "y"], list(features), "feature", "x")
    return long.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*keys, "feature", "x").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")
    )


def best_splits(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), min_side: int = 2
) -> DataFrame:
    """Best split ``x <= value`` over all features, one row per key.

    A side needs ``min_side`` rows and the error must fall under the parent's.
    Ties go to the earlier feature of the list, then to the smaller value.
    """
    keys = list(keys)
    sums = cut_lineage(feature_value_sums(df, features, target, keys))
    errors = split_errors(sums, keys=[*keys, "feature"])
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    valid = errors.filter(
        (F.col("ln") >= min_side) & (F.col("rn") >= min_side) & (F.col("sse") < F.col("parent_sse"))
    )
    best = F.min(F.struct("sse", order.alias("feature_no"), "x", "feature", "ln", "rn"))
    return valid.groupBy(*keys).agg(best.alias("b")).select(
        *keys, "b.feature", F.col("b.x").alias("split"), "b.sse",
        F.col("b.ln").alias("n_left"), F.col("b.rn").alias("n_right"),
    )


@dataclass
class Node:
    """Tree node on the driver: either a split with two children or a leaf value."""

    value: float | None = None
    feature: str | None = None
    split: float | None = None
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> int:
        return 1 if self.feature is None else self.left.leaves() + self.right.leaves()

    def height(self) -> int:
        return 1 if self.feature is None else 1 + max(self.left.height(), self.right.height())

    def column(self) -> Column:
        """Value of the row's leaf as one nested CASE expression."""
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(F.col(f"`{self.feature}`") > self.split, self.right.column()).otherwise(self.left.column())

    def listing(self) -> list[dict[str, float | str]]:
        if self.feature is None:
            return [{"value": self.value}]
        here = {"feature": self.feature, "split": self.split}
        return [here, *self.left.listing(), *self.right.listing()]


def grow_tree(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    leaf_terms: Mapping[str, Column],
    leaf_value,
    min_rows: int,
    min_error: float,
    max_height: int,
) -> Node:
    """Regression tree by levels: every open node of a level is split in one job.

    ``leaf_terms`` are aggregates per node (``n`` and ``sse`` come along) and
    ``leaf_value`` turns their row into the leaf's value.
    """
    root = Node()
    level: dict[int, Node] = {0: root}
    route: Column = F.lit(0)
    y = F.col(target).cast("double")
    for depth in range(1, max_height + 1):
        routed = df.withColumn("_node", route)
        stats = routed.filter(F.col("_node").isin(list(level))).groupBy("_node").agg(
            F.count(F.lit(1)).alias("n"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("sse"),
            *[c.alias(k) for k, c in leaf_terms.items()],
        )
        # one row per open node, at most 2 ** max_height
        facts = {r["_node"]: r for r in stats.toLocalIterator()}
        open_nodes = [
            i for i in level
            if i in facts and facts[i]["n"] > min_rows and facts[i]["sse"] > min_error and depth < max_height
        ]
        for i, node in level.items():
            node.value = leaf_value(facts[i]) if i in facts else 0.0
        if not open_nodes:
            break
        rows = routed.filter(F.col("_node").isin(open_nodes))
        found = {r["_node"]: r for r in best_splits(rows, features, target, ["_node"]).toLocalIterator()}
        following: dict[int, Node] = {}
        step = F.lit(-1)
        for i, r in found.items():
            node = level[i]
            node.feature, node.split = r.feature, r.split
            node.left, node.right = Node(), Node()
            following[2 * i + 1], following[2 * i + 2] = node.left, node.right
            side = F.when(F.col(f"`{r.feature}`") > r.split, 2 * i + 2).otherwise(2 * i + 1)
            step = F.when(route == i, side).otherwise(step)
        route = step
        level = following
        if not level:
            break
    return root


@dataclass
class LogisticBoosting:
    """Boosted trees on the log odds with Newton leaf values."""

    init: float
    rate: float
    trees: list[Node]

    def log_odds(self) -> Column:
        out: Column = F.lit(self.init)
        for tree in self.trees:
            out = out + F.lit(self.rate) * tree.column()
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))
        scored = df.withColumn("score", p)
        return scored.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def fit_logistic_boosting(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    rounds: int = 5,
    rate: float = 0.1,
    min_rows: int = 2,
    min_error: float = 1e-6,
    max_height: int = 3,
) -> LogisticBoosting:
    """Start at the log odds, then add a tree on the residuals per round.

    A leaf's value is sum(r) / sum(p (1 - p)) with r the residual and p the
    probability before the round.
    """
    y = F.col(label).cast("double")
    counts = df.agg(F.sum(y).alias("p"), F.count(y).alias("n")).select(
        F.log(safe_ratio(F.col("p"), F.col("n") - F.col("p"))).alias("f0")
    ).first()
    if counts.f0 is None:
        raise ValueError("both classes are needed")
    model = LogisticBoosting(counts.f0, rate, [])
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], y.alias("_y"))
    rows = cut_lineage(rows.withColumn("_f", F.lit(model.init)))
    for _ in range(rounds):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_f")))
        current = rows.withColumn("_p", p).withColumn("_r", F.col("_y") - F.col("_p"))
        terms = {"r": F.sum("_r"), "w": F.sum(F.col("_p") * (1 - F.col("_p")))}
        tree = grow_tree(
            current, features, "_r", terms,
            lambda row: row["r"] / row["w"] if row["w"] else 0.0,
            min_rows, min_error, max_height,
        )
        model.trees.append(tree)
        # the log odds live in a written column, so plans stay one tree deep
        rows = cut_lineage(rows.withColumn("_f", F.col("_f") + F.lit(rate) * tree.column()))
    return model
