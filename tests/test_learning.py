import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from breathline.learning import evaluation, models, neighbours, splits


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    label = rng.integers(0, 2, 900)
    score = np.round(rng.normal(label * 0.7, 1.0), 1) + 0.0  # no negative zero
    rows = [(i, int(i % 3), int(y), float(s)) for i, (y, s) in enumerate(zip(label, score, strict=True))]
    return spark.createDataFrame(rows, "id int, fold int, label int, score double").cache()


def test_auc_agrees_with_spark_ml(scored):
    ours = evaluation.auc_and_ks(scored).first()
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(
        scored.withColumn("label", F.col("label").cast("double"))
    )
    assert abs(ours.auc - theirs) < 1e-12
    points = evaluation.roc_points(scored).collect()
    assert abs(ours.ks - max(p.tpr - p.fpr for p in points)) < 1e-12
    assert max(p.tpr for p in points) == max(p.fpr for p in points) == 1.0


def test_mean_roc_agrees_with_numpy_interpolation(scored):
    rows = scored.toPandas()
    grid, curves = np.arange(100) / 99, []
    for _, part in rows.groupby("fold"):
        cuts = np.sort(part.score.unique())[::-1]
        pos, neg = part.score[part.label == 1].to_numpy(), part.score[part.label == 0].to_numpy()
        tpr = np.r_[0, [(pos >= c).mean() for c in cuts]]
        fpr = np.r_[0, [(neg >= c).mean() for c in cuts]]
        curve = np.interp(grid, fpr, tpr)
        curve[0] = 0
        curves.append(curve)
    mean, sd = np.mean(curves, axis=0), np.std(curves, axis=0)
    mean[-1] = 1.0
    out = evaluation.mean_roc(evaluation.roc_points(scored, ["fold"]))
    got = out.orderBy("g").toPandas()
    np.testing.assert_allclose(got.fpr, grid)
    np.testing.assert_allclose(got.tpr, mean, atol=1e-9)
    np.testing.assert_allclose(got.upper, np.minimum(mean + sd, 1), atol=1e-9)
    np.testing.assert_allclose(got.lower, np.maximum(mean - sd, 0), atol=1e-9)
    area = ((got.fpr.diff() * (got.tpr + got.tpr.shift()) / 2).sum())
    assert abs(evaluation.mean_auc(out).first().mean_auc - area) < 1e-9


def test_confusion_and_metrics(scored):
    predicted = scored.withColumn("prediction", (F.col("score") > 0.3).cast("int"))
    cells = {(r.label, r.prediction): r.n for r in evaluation.confusion_matrix(predicted).collect()}
    m = evaluation.classification_metrics(predicted).first()
    assert sum(cells.values()) == 900 and cells[1, 1] == m.tp and cells[0, 1] == m.fp
    assert m.accuracy == (m.tp + m.tn) / 900 and m.sensitivity == m.tpr == m.tp / (m.tp + m.fn)
    precision, recall = m.ppv, m.sensitivity
    assert abs(m.f1 - 2 * precision * recall / (precision + recall)) < 1e-12


def test_metrics_of_one_class_are_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6)], "label int, score double")
    row = evaluation.auc_and_ks(df).first()
    assert row.auc is None


# Ten points on which additive stumps are a textbook example.
TEN = [5.56, 5.70, 5.91, 6.40, 6.80, 7.05, 8.90, 8.70, 9.00, 9.05]


def brute_stumps(x, y, error, rounds=100):
    x, y = np.asarray(x, float), np.asarray(y, float)
    rest, found = y.copy(), []
    values = np.unique(x)
    while len(found) < rounds:
        options = []
        for cut in (values[1:] + values[:-1]) / 2:
            left, right = rest[x < cut], rest[x > cut]
            options.append((((left - left.mean()) ** 2).sum() + ((right - right.mean()) ** 2).sum(), cut, left.mean(), right.mean()))
        sse, cut, left, right = min(options)
        found.append((cut, left, right))
        rest = rest - np.where(x < cut, left, right)
        if (rest**2).sum() < error:
            break
    return found


def test_boosted_stumps(spark):
    df = spark.createDataFrame([(float(i + 1), v) for i, v in enumerate(TEN)], "x double, y double")
    got = splits.boosted_stumps(df, "x", "y", error=0.18)
    want = brute_stumps(range(1, 11), TEN, 0.18)
    assert len(got) == len(want) and got[0].split == 6.5
    for s, (cut, left, right) in zip(got, want, strict=True):
        assert s.split == cut
        np.testing.assert_allclose([s.left, s.right], [left, right], atol=1e-9)
    fitted = df.select("y", splits.predict_stumps(got, F.col("x")).alias("p")).collect()
    assert sum((r.y - r.p) ** 2 for r in fitted) < 0.18


def brute_split(x, y, min_side=2):
    parent, best = y.var() * len(y), None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f]):
            left, right = y[x[:, f] <= v], y[x[:, f] > v]
            if len(left) >= min_side and len(right) >= min_side:
                sse = left.var() * len(left) + right.var() * len(right)
                if sse < (best[0] if best else parent) - 1e-12:
                    best = (sse, f, v)
    return best


def brute_tree(x, y, p, height, min_rows, min_error):
    leaf = y.sum() / (p * (1 - p)).sum()
    best = brute_split(x, y)
    if len(y) <= min_rows or height == 1 or y.var() * len(y) <= min_error or best is None:
        return lambda q: np.full(len(q), leaf)
    _, f, v = best
    side = x[:, f] > v
    left = brute_tree(x[~side], y[~side], p[~side], height - 1, min_rows, min_error)
    right = brute_tree(x[side], y[side], p[side], height - 1, min_rows, min_error)
    return lambda q: np.where(q[:, f] > v, right(q), left(q))


def test_logistic_boosting_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(120, 3)), 2)
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=120)) > 0).astype(int)
    rows = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    model = splits.fit_logistic_boosting(df, ["a", "b", "c"], "y", rounds=2, rate=0.5, min_rows=4, max_height=3)
    odds = np.full(120, np.log(y.mean() / (1 - y.mean())))
    for _ in range(2):
        p = 1 / (1 + np.exp(-odds))
        odds = odds + 0.5 * brute_tree(x, y - p, p, 3, 4, 1e-6)(x)
    got = [r.score for r in model.transform(df).orderBy("id").collect()]
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-odds)), atol=1e-9)
    tree = model.trees[0]
    assert tree.height() <= 3 and tree.leaves() == sum("value" in n for n in tree.listing())


def test_neighbours_match_brute_force_with_small_chunks(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(c, 0.3, (60, 5)) for c in (0, 4, 8)] + [np.zeros((20, 5))])
    rows = [(i, v.tolist(), int(i % 3), int(i % 4)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int, fold int")
    got = neighbours.out_of_fold_neighbours(df, "id", "v", "label", "fold", 7, chunk_rows=25).collect()
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    for i in range(len(rows)):
        others = [j for j in range(len(rows)) if j % 4 != i % 4]
        want = sorted(others, key=lambda j: (d[i, j], j))[:7]
        mine = [r.neighbour_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])]
        assert mine == want
    fine = neighbours.out_of_fold_neighbours(df, "id", "v", "label", "fold", 7, chunk_rows=25, ring_rows=3)
    assert sorted(map(tuple, fine.collect())) == sorted(map(tuple, got))
    votes = neighbours.vote(df.sparkSession.createDataFrame([(1, 5, 1), (1, 3, 2), (1, 5, 3)], "query_id int, neighbour_label int, rank int"), [1, 2, 3])
    assert {r.k: r.prediction for r in votes.collect()} == {1: 5, 2: 3, 3: 5}


def test_neighbours_without_structure_are_compared_in_blocks(spark, monkeypatch):
    """Nearly every ring would be visited: a query goes to each chunk of points once, not to each ring."""
    rng = np.random.default_rng(9)
    vectors = np.concatenate([rng.normal(size=(1200, 32)), np.ones((70, 32)), 1e6 + rng.normal(size=(30, 32))])
    rows = [(i, v.tolist(), int(i % 3), int(i % 5)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int, fold int")
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 500)
    queries, points = neighbours._plan_search(neighbours._search_rows(df, "id", "v", "label", "fold"), 6, neighbours.CHUNK_ROWS, 50)
    assert queries.count() == 3 * 1300 and points.groupBy("chunk").count().count() == 3
    got = {}
    for r in neighbours.out_of_fold_neighbours(df, "id", "v", "label", "fold", 6, ring_rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbour_id))
    for i in range(0, 1300, 7):
        d = np.sqrt(((vectors[i] - vectors) ** 2).sum(axis=1))
        want = sorted((j for j in range(1300) if j % 5 != i % 5), key=lambda j: (d[j], j))[:6]
        assert [j for _, j in sorted(got[i])] == want


def test_rings_of_cells_spare_comparisons(spark):
    """Points along a few lines through far centres: the rings of a cell are visited one by one."""
    rng = np.random.default_rng(6)
    vectors = np.stack([np.where(np.arange(4) == i % 4, 1000.0, 0) + np.array([rng.uniform(0, 100), 0, 0, 0]) for i in range(1500)])
    folds = np.arange(1500) // 4 % 2
    rows = [(i, v.tolist(), 0, int(folds[i])) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int, fold int")
    whole = neighbours.compared_pairs(df, "id", "v", "label", "fold", 5, ring_rows=10**6).first()
    fine = neighbours.compared_pairs(df, "id", "v", "label", "fold", 5, ring_rows=10).first()
    assert whole.rows == fine.rows == 1500 and whole.pairs < 1500 * 1500 / 4
    assert fine.pairs < 0.6 * whole.pairs
    got = neighbours.out_of_fold_neighbours(df, "id", "v", "label", "fold", 5, ring_rows=10).collect()
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    near = {}
    for r in got:
        near.setdefault(r.query_id, []).append((r.distance, r.neighbour_id))
    for i in range(0, 1500, 50):
        others = np.flatnonzero(folds != folds[i])
        want = others[np.lexsort((others, d[i, others]))[:5]].tolist()
        assert [j for _, j in sorted(near[i])] == want


def test_fits_deal_their_rows_to_every_core(spark):
    seen = []

    class Watch:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))

    models.fit(Watch(), spark.range(1000).coalesce(1))
    assert seen == [(spark.sparkContext.defaultParallelism, 1000)]


def test_trees_search_and_summary(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2))
    rows = [(i, float(a), float(b), int(a > 0), int(i % 3)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int, fold int")
    tree = models.tree_classifier(minInstancesPerNode=1)
    pipeline = models.feature_pipeline(["a", "b"], tree)
    fitted = models.fit(pipeline, df)
    scored = models.score(fitted, df, ["id", "label"])
    assert scored.filter("label = prediction").count() >= 195
    assert models.tree_summary(df, fitted).first().height <= 4
    assert "If (feature" in models.split_listing(fitted)
    assert models.feature_weights(df, fitted, ["a", "b"]).orderBy(F.desc("importance")).first().feature == "a"
    found = models.cross_validate(pipeline, models.param_grid(tree, {"maxDepth": [1, 3]}), df, "fold", 3, models.accuracy())
    table = models.search_table(df, found).collect()
    assert len(table) == 2 and sum(r.best for r in table) == 1 and all(r["mean"] > 0.9 for r in table)
    drawn = models.random_params(models.logistic(), {"regParam": (1e-3, 1.0), "maxIter": [5, 9]}, 6)
    values = [{p.name: v for p, v in m.items()} for m in drawn]
    assert all(1e-3 <= v["regParam"] <= 1 and v["maxIter"] in (5, 9) for v in values)


def test_registered_queries_fit_with_the_sizes_of_the_study(spark, monkeypatch):
    from breathline.catalog import learners

    def settings(estimator):
        return {p.name: v for p, v in estimator.extractParamMap().items()}

    monkeypatch.setattr(learners, "_doc_scores", lambda spark, d, estimator, **options: settings(estimator))
    assert [f(spark, "")["maxIter"] for f in (learners.gbt_classifier, learners.gbt_weighted, learners.gbt_regressor)] == [600, 600, 500]
    forests = (learners.random_forest, learners.forest_regressor, learners.bagged_trees, learners.bagged_regressor)
    assert [(f(spark, "")["numTrees"], f(spark, "")["maxDepth"]) for f in forests] == [(150, 30), (150, 30), (500, 3), (500, 30)]
    seen = {}

    def noted(name):
        return lambda *args, **options: seen.setdefault(name, (args, options))

    monkeypatch.setattr(learners, "labelled_documents", lambda spark, d: spark.range(1).withColumn("fold", F.lit(1)))
    monkeypatch.setattr(learners, "embedded", lambda spark, d: spark.range(1))
    for name in ("stacked_scores", "fit", "tree_summary", "search_table"):
        monkeypatch.setattr(models, name, noted(name))
    monkeypatch.setattr(learners.kernel_svcs, "svc_search", lambda *args: seen.setdefault(len(args[-1]), args))
    monkeypatch.setattr(learners.boosting, "boosting_search", lambda *args, **options: seen.setdefault("boosting", []).append((args, options)))
    bags = lambda rows, *args: seen.setdefault("bags", args) and spark.createDataFrame([], "doc_id long, score double")
    monkeypatch.setattr(learners.forest_bags, "bag_scores", bags)
    monkeypatch.setattr(models, "stacked_scores", lambda *args, **options: (noted("stacking")(*args, **options), None))
    monkeypatch.setattr(models, "cross_validate", lambda pipeline, grid, *args: seen.setdefault("random", settings(pipeline.getStages()[-1])))
    monkeypatch.setattr(learners, "labelled_documents", lambda spark, d: spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(1).alias("label"), F.lit(1).alias("fold")))
    for query in (learners.bagged_forests, learners.kernel_svc_search, learners.svc_random_search, learners.stacking, learners.grid_search, learners.boosted_weight_search, learners.random_search, learners.tree_summary):
        query(spark, "")
    assert seen["bags"][4:] == (500, 150, 2, 30) and len(seen[25][-1]) == 25
    assert all(0.1 <= c <= 10_000.1 and 1e-6 <= g <= 10 for c, g in seen[20][-1])
    (grid, _), (weighted, options) = seen["boosting"]
    assert [math.prod(map(len, args[5:])) for args in (grid, weighted)] == [45, 144] and options["by_curvature"]
    assert "forest" not in seen["stacking"][1] and settings(seen["fit"][0][0].getStages()[-1])["numTrees"] == 150
    assert seen["random"]["maxIter"] == 1000
