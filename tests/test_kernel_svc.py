"""RBF classifiers against the optimality conditions and against a dense solution; bags of forests against loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathline.learning import forest_bags, kernel_svc
from breathline.learning.boosting import BinnedRows
from breathline.learning.forest_bags import bag_scores, bag_weight, bag_weight_column, forest, grow_trees, tree_weight
from breathline.learning.kernel_svc import decision_values, fit_cascade, fit_sigmoid, rbf, solve_dual, solve_rows, svc_scores, svc_search


def clouds(n, seed=1, apart=1.0):
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)
    return rng.normal(size=(n, 3)) + apart * y[:, None] * [1, 0.5, 0], y


def frame(spark, x, y, fits=1):
    rows = [(k, i, v, float(s)) for k in range(fits) for i, (v, s) in enumerate(zip(x.tolist(), y, strict=True))]
    return spark.createDataFrame(rows, "fit long, id long, x array<double>, y double")


@pytest.mark.parametrize("c, gamma", [(0.1, 0.5), (1.0, 0.5), (50.0, 2.0), (1000.0, 0.01)])
def test_dual_solution_meets_its_conditions(c, gamma):
    x, y = clouds(150)
    kernel = rbf(x, x, gamma)
    alpha, offset = solve_dual(kernel, y, c)
    assert (alpha >= 0).all() and (alpha <= c * (1 + 1e-9)).all() and abs(alpha @ y) < 1e-6 * c
    value = kernel @ (alpha * y) + offset
    square = (alpha * y) @ kernel @ (alpha * y)
    primal, dual = square / 2 + c * np.maximum(0, 1 - y * value).sum(), alpha.sum() - square / 2
    assert 0 <= primal - dual + 1e-9 and primal - dual <= 2e-3 * primal


@pytest.mark.parametrize("c, gamma", [(0.1, 0.5), (1.0, 0.5), (50.0, 2.0), (1000.0, 0.01)])
def test_rows_are_solved_without_their_whole_kernel(c, gamma, monkeypatch):
    x, y = clouds(300, seed=4, apart=0.6)
    dense, offset = solve_dual(rbf(x, x, gamma), y, c)
    largest, whole_kernel = [], kernel_svc.rbf
    monkeypatch.setattr(kernel_svc, "rbf", lambda a, b, g: largest.append(len(a) * len(b)) or whole_kernel(a, b, g))
    monkeypatch.setattr(kernel_svc, "CELLS", 2_000)
    monkeypatch.setattr(kernel_svc, "MOST_WORKING", 60)
    alpha, found = solve_rows(x, y, c, gamma, whole=0, working=20)
    assert max(largest) <= 60 * 60 and (alpha >= 0).all() and (alpha <= c * (1 + 1e-9)).all() and abs(alpha @ y) < 1e-6 * c
    kernel = whole_kernel(x, x, gamma)
    value = lambda a: a.sum() - (a * y) @ kernel @ (a * y) / 2
    assert value(alpha) == pytest.approx(value(dense), rel=1e-3) and found == pytest.approx(offset, abs=0.02)
    again, _ = solve_rows(x, y, c, gamma, alpha, whole=300, working=20)
    assert value(again) >= value(alpha) - 1e-9 * abs(value(alpha))


def test_scan_and_scores_hold_a_bounded_part_of_the_kernel(spark, monkeypatch):
    x, y = clouds(200, seed=6, apart=0.3)
    monkeypatch.setattr(kernel_svc, "CELLS", 1_000)
    largest, whole_kernel = [], kernel_svc.rbf
    monkeypatch.setattr(kernel_svc, "rbf", lambda a, b, g: largest.append(len(a) * len(b)) or whole_kernel(a, b, g))
    weight = np.arange(200.0)
    assert np.allclose(kernel_svc.kernel_sums(x, x, weight, 0.5), whole_kernel(x, x, 0.5) @ weight) and max(largest) <= 1_000


def test_cascade_ends_where_one_solver_does(spark):
    x, y = clouds(240, seed=3, apart=0.8)
    fits = [(1.0, 0.5), (20.0, 0.2)]
    state, checks = fit_cascade(frame(spark, x, y, 2), fits, block_rows=40)
    checks = {r.fit: r for r in checks.collect()}
    values = {(r.fit, r.id): r.value for r in decision_values(state, frame(spark, x, y, 2), fits, block_rows=50).collect()}
    for k, (c, gamma) in enumerate(fits):
        kernel = rbf(x, x, gamma)
        alpha, offset = solve_dual(kernel, y, c, tolerance=1e-6, gap=1e-6)
        dense = kernel @ (alpha * y) + offset
        best = alpha.sum() - (alpha * y) @ kernel @ (alpha * y) / 2
        assert checks[k].rows == 240 and checks[k].gap <= 0.01 and checks[k].dual == pytest.approx(best, rel=0.01)
        assert np.abs(np.array([values[k, i] for i in range(240)]) - dense).max() < 0.15
        assert checks[k].support == state.where(F.col("fit") == k).count() < 240


def test_one_class_and_empty_tables(spark):
    x, _ = clouds(6)
    state, checks = fit_cascade(frame(spark, x, np.ones(6)), [(1.0, 1.0)])
    assert checks.first().gap == 0 and state.first().offset == 1.0
    assert [r.value for r in decision_values(state, frame(spark, x, np.ones(6)), [(1.0, 1.0)]).collect()] == [1.0] * 6
    state, checks = fit_cascade(frame(spark, x, np.ones(6)).where("false"), [(1.0, 1.0)])
    assert state.count() == 0 and checks.count() == 0


def test_search_and_calibrated_scores(spark):
    x, y = clouds(120, seed=5, apart=1.5)
    df = spark.createDataFrame([(i, v, int(s > 0), (i // 2) % 3) for i, (v, s) in enumerate(zip(x.tolist(), y, strict=True))], "id long, v array<double>, label int, fold int")
    found = svc_search(df, "id", "v", "label", "fold", 3, [(1.0, 0.5), (1.0, 1e-6)], block_rows=30).collect()
    assert [r.rows for r in found] == [120, 120] and all(r.gap <= 0.01 for r in found) and [r.best for r in found] == [True, False]
    scored = svc_scores(df, "id", "v", "label", "fold", 3, 1.0, 0.5).collect()
    assert len(scored) == 120 and all(0 <= r.score <= 1 for r in scored)
    assert np.mean([(r.score > 0.5) == (r.label == 1) for r in scored]) > 0.85
    assert all((a.value < b.value) == (a.score < b.score) or a.value == b.value for a, b in zip(scored[:1] * 9, scored[1:10], strict=True) if (a.id // 2) % 3 == (b.id // 2) % 3)


def test_sigmoid_has_the_least_loss(spark):
    rng = np.random.default_rng(7)
    value = rng.normal(size=400) * 2
    y = np.where(rng.random(400) < 1 / (1 + np.exp(-(1.5 * value - 0.5))), 1.0, -1.0)
    a, b = fit_sigmoid(spark.createDataFrame(list(zip(y.tolist(), value.tolist(), strict=True)), "y double, value double"))
    p, n = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))

    def loss(a, b):
        z = a * value + b
        return (target * z + np.logaddexp(0, -z)).sum()

    assert -2.2 < a < -1.0 and all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert fit_sigmoid(spark.createDataFrame([(1.0, 2.0)], "y double, value double"))[0] == 0.0


# --- bags of forests ---------------------------------------------------------


def test_weights_are_poisson_draws_and_the_same_in_sql(spark):
    ids = np.arange(3000)
    drawn = bag_weight(ids, 7)
    assert abs(drawn.mean() - 1) < 0.06 and abs(drawn.var() - 1) < 0.12 and not np.array_equal(drawn, bag_weight(ids, 8))
    column = spark.range(3000).select(bag_weight_column(F.col("id"), 7).alias("w")).toPandas().w.to_numpy()
    assert np.array_equal(column, drawn)
    inner = tree_weight(ids[None, :], 7, np.arange(4)[:, None], np.broadcast_to(drawn, (4, 3000)))
    assert (inner[:, drawn == 0] == 0).all() and abs(inner.mean() - 1) < 0.08 and abs(np.corrcoef(inner[0], inner[1])[0, 1] - 0.5) < 0.1


def test_trees_grown_together_equal_single_growth():
    rng = np.random.default_rng(2)
    bins, labels = rng.integers(0, 9, (80, 3)), rng.integers(0, 2, 80).astype(float)
    weights = rng.poisson(1, (5, 80))
    together = grow_trees(bins, labels, weights, 10, features_each=3).leaf_shares(bins)

    def plain(rows):
        n, h = weights[t][rows].sum(), (weights[t] * labels)[rows].sum()
        best = (1e-12, None)
        if 0 < h < n:
            for f in range(3):
                for cut in range(10):
                    a = rows[bins[rows, f] <= cut]
                    na, ha = weights[t][a].sum(), (weights[t] * labels)[a].sum()
                    if 0 < na < n and (gain := ha**2 / na + (h - ha) ** 2 / (n - na) - h * h / n) > best[0] + 1e-13:
                        best = (gain, (f, cut))
        if best[1] is None:
            share[rows] = h / n if n else 0.5
            return
        low = bins[rows, best[1][0]] <= best[1][1]
        plain(rows[low])
        plain(rows[~low])

    for t in range(5):
        share = np.zeros(80)
        plain(np.arange(80))
        assert np.allclose(together[t], share)


def test_best_cuts_are_the_same_in_cells_and_in_order(monkeypatch):
    rng = np.random.default_rng(8)
    bins, node, feature = rng.integers(0, 65, (4000, 3)).astype(np.uint8), rng.integers(0, 900, 4000), rng.integers(0, 3, 4000)
    w, y, row = rng.integers(1, 5, 4000).astype(float), rng.integers(0, 2, 4000), np.arange(4000)
    cells, made = [], np.bincount
    monkeypatch.setattr(forest_bags.np, "bincount", lambda x, weights, size: cells.append(size) or made(x, weights, size))
    for nodes in (node, node % 4):  # few rows a node: in order; many: in cells
        slots = nodes.max() + 1
        n, h = made(nodes, w, slots), made(nodes, w * y, slots)
        gain, cell = forest_bags.best_cuts(bins.ravel(), row, w, w * y, nodes, feature, n, h, 3, 65)
        for k in range(min(slots, 40)):
            for f in range(3):
                best, mine = (-1.0, 0), np.flatnonzero((nodes == k) & (feature == f))
                for c in sorted(set(bins[mine, f].tolist())):
                    left = mine[bins[mine, f] <= c]
                    a, b = w[left].sum(), (w * y)[left].sum()
                    if a < n[k] and (g := b * b / a + (h[k] - b) ** 2 / (n[k] - a) - h[k] * h[k] / n[k]) > best[0]:
                        best = (g, c)
                assert gain[k, f] == best[0] and (best[0] < 0 or cell[k, f] == best[1])
    assert max(cells) <= 4 * 4000


def test_bag_scores_do_not_depend_on_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), int(a > 4), i % 5) for i, (a, b) in enumerate(rng.integers(0, 9, (90, 2)))]
    df = spark.createDataFrame([(*r[:1], None if i == 4 else r[1], *r[2:]) for i, r in enumerate(rows)], "id long, a double, b double, y int, fold int")

    def run():
        return {r.id: (r.score, r.low, r.high) for r in bag_scores(df, "id", ["a", "b"], "y", F.col("fold") != 0, bags=6, trees=5, features_each=1).collect()}

    whole = run()
    monkeypatch.setattr(forest_bags, "TOGETHER", 1)
    assert run() == whole and len(whole) == 90
    assert np.mean([(whole[i][0] > 0.5) == (y == 1) for i, _, _, y, _ in rows]) > 0.9
    binned = forest_bags.binned_rows(df.where("fold <> 0"), "id", ["a", "b"], "y")
    table = df.select("id", "a", "b").toArrow()
    each = np.array([forest(binned, bag, 5, 1, 30).leaf_shares(forest_bags.bin_numbers(table, binned.cuts)).mean(axis=0) for bag in range(6)])
    for i, score in zip(table.column("id").to_pylist(), each.mean(axis=0), strict=True):
        assert whole[i][0] == pytest.approx(score, abs=1e-6)
    assert bag_scores(df.where("false"), "id", ["a", "b"], "y", F.col("fold") != 0, bags=2, trees=2).count() == 0


def test_rows_beyond_the_bound_are_scored_too(spark):
    df = spark.range(300).select("id", (F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 9 > 4).cast("int").alias("y"))
    found = bag_scores(df, "id", ["a"], "y", F.lit(True), bags=2, trees=3, features_each=1, most=60).collect()
    assert len(found) == 300 and np.mean([(r.score > 0.5) == (r.id % 9 > 4) for r in found]) > 0.95
    assert isinstance(BinnedRows, type) and math.isfinite(found[0].low)


def test_bags_learn_from_every_row(spark):
    # more rows than the 100,000 that a bag was once cut to; the values of the rows beyond are in none of the others
    df = spark.range(100_600).select("id", F.when(F.col("id") < 600, F.col("id") % 2 + 10.0).otherwise(F.col("id") % 2).alias("a"), F.when(F.col("id") < 600, F.col("id") % 2).otherwise(1 - F.col("id") % 2).cast("int").alias("y"))
    seen = []
    found = bag_scores(df, "id", ["a"], "y", F.lit(True), bags=2, trees=2, features_each=1).collect()
    binned = forest_bags.binned_rows(df, "id", ["a"], "y")
    assert len(binned.ids) == 100_600 and len(found) == 100_600
    for r in found:
        seen.append((r.score > 0.5) == (r.id % 2 == (1 if r.id < 600 else 0)))
    assert all(seen)


def test_trees_of_a_bag_may_be_grown_in_groups(monkeypatch):
    rng = np.random.default_rng(4)
    rows = BinnedRows(np.arange(300), rng.integers(0, 9, (300, 2)).astype(np.uint8), rng.integers(0, 2, 300).astype(float), np.zeros(300), 10)
    whole = forest(rows, 3, 6, 2, 30).leaf_shares(rows.bins)
    monkeypatch.setattr(forest_bags, "HELD", 600)
    groups = forest_bags.tree_groups(6, 300)
    assert [len(g) for g in groups] == [2, 2, 2]
    # a node looks at all features here, so that the draws of features do not matter
    assert np.allclose(np.concatenate([forest(rows, 3, 6, 2, 30, g).leaf_shares(rows.bins) for g in groups]), whole)
