import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathline.functions import rules
from breathline.operators import distribution, imputation, joins, ordering, reshape, sampling, summaries

LONG = "stay_id bigint, offset_min int, name string, value double"


def test_interval_window_edges(spark):
    rows = [(1, t, "x", 1.0) for t in (99, 100, 1539, 1540, 1541)] + [(2, 100, "x", 1.0)]
    m = spark.createDataFrame(rows, LONG)
    w = spark.createDataFrame([(1, 100, 1540)], "stay_id bigint, a int, b int")

    def times(**options):
        return sorted(r.offset_min for r in joins.interval_join(m, w, "a", "b", **options).collect())

    assert times() == [100, 1539]
    assert times(closed="right") == [1539, 1540]
    assert sorted(r.offset_min for r in joins.interval_join(m, w, "b", None).collect()) == [1540, 1541]


def test_interval_join_matches_plain_join_with_hot_stay_and_copies(spark):
    rng = random.Random(3)
    rows = [(7, 50, "x", 1.0)] * 500
    rows += [(7 if rng.random() < 0.4 else rng.randint(0, 30), rng.randint(-3000, 9000), "x", 1.0) for _ in range(1500)]
    m = spark.createDataFrame(rows, LONG).repartition(5)
    w = spark.createDataFrame(
        [(s, a := rng.randint(-3000, 5000), a + rng.randint(-5, 4000)) for s in range(0, 31)] + [(7, 0, 100)],
        "stay_id bigint, a int, b int",
    )
    got = joins.interval_join(m, w, "a", "b").select("stay_id", "offset_min", "a").collect()
    plain = m.join(w, "stay_id").filter("offset_min >= a AND offset_min < b").select("stay_id", "offset_min", "a")
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain.collect())) and len(got) > 500


def test_peep_check_edges(spark):
    rows = [(1, 520, rules.PEEP, 4.0), (2, 1000, rules.PEEP, 4.0), (3, 900, rules.PEEP, 5.0), (4, 900, rules.PEEP, None)]
    m = spark.createDataFrame(rows, LONG)
    onsets = spark.createDataFrame([(i, 1000) for i in range(1, 6)], "stay_id bigint, onset bigint")
    kept = sorted(r.stay_id for r in joins.reject_low_peep(m, onsets).collect())
    assert kept == [1, 3, 4, 5]


def test_null_ids_exclude_nothing(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    bad = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r.k for r in joins.without_ids(base, [bad], "k").collect()] == [2]


def test_refresh_keeps_unmatched_rows(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, status int, other string")
    new = spark.createDataFrame([(2, 7)], "id int, status int")
    got = joins.refresh_columns(df, new, "id", ["status"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a"), (2, 7, "b")]


def test_distribution_matches_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {
        1: rng.normal(50, 20, 801), 2: np.full(40, 5.0), 3: np.array([7.0]), 4: rng.integers(-5, 5, 100).astype(float),
        5: np.array([1e-12, 1e12, -1e12, 0.0]), 6: np.repeat(rng.normal(100, 0.01, 50), 3) + 1e6,
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(1, None), (2, float("nan"))]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    out = distribution.distribution(df, ["k"], "v", {"q1": 0.25, "med": 0.5, "p9": 0.9})
    got = {r.k: r for r in out.collect()}
    for k, xs in groups.items():
        r = got[k]
        assert r.n == len(xs) and r.min_value == xs.min() and r.max_value == xs.max()
        np.testing.assert_allclose([r.q1, r.med, r.p9], np.quantile(xs, [0.25, 0.5, 0.9]), rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(r["mean"], xs.mean(), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(r.var_pop, xs.var(), rtol=1e-6, atol=1e-9)


def test_feature_statistics_rules(spark):
    rows = [(1, 0, "c", 5.0)] * 3 + [(1, 0, "s", 7.0), (1, 0, "z", 0.0), (2, 0, "e", 1.0), (2, 1, "e", 2.25)]
    got = {
        (r.stay_id, r.name): (r["median"], r.variances, r.changerate)
        for r in distribution.feature_statistics(spark.createDataFrame(rows, LONG)).collect()
    }
    assert got == {(1, "c"): (5.0, 0.0, 0.0), (1, "s"): (7.0, 0.0, 0.0), (2, "e"): (1.62, 0.39, 1.25)}


def test_box_statistics(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    r = distribution.box_statistics(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (r.q1, r.q2, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2.25, 3.5, 4.75, 1.0, 5.0, 1)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_numpy(spark, descending):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(x), int(n)) for g in range(3) for x, n in zip(rng.permutation(500), rng.integers(0, 9, 500), strict=True)]
    df = spark.createDataFrame(rows, "g int, x double, n bigint")
    splits = ordering.quantile_splits(df, "x", 16)
    out = ordering.running_totals(df, "x", {"n": "total"}, ["g"], descending, splits).collect()
    for g in range(3):
        mine = sorted([(r.x, r.n, r.total) for r in out if r.g == g], reverse=descending)
        assert [m[2] for m in mine] == list(np.cumsum([m[1] for m in mine])) and len(mine) == 500


def test_positions_and_slices(spark):
    df = spark.range(100, 350)
    assert [r.id for r in ordering.slice_rows(df, "id", 10, 13).orderBy("id").collect()] == [110, 111, 112]
    sizes = ordering.equal_slices(df, "id", 70).groupBy("slice").count().orderBy("slice").collect()
    assert [tuple(r) for r in sizes] == [(0, 70), (1, 70), (2, 70), (3, 40)]


def test_merge_flags_takes_the_larger(spark):
    a = spark.createDataFrame([(1, 1, 0)], "k int, x int, y int")
    b = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "k int, x int, z int")
    got = reshape.merge_flags([a, b], "k", ["x", "y", "z"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 1), (2, 1, 0, 0)]


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 20.0, 4.0), (3, 30.0, 0.0)], "id int, bmi double, x double")
    means = imputation.fit_means(df, ["bmi", "x"], {"bmi": 10})
    got = imputation.impute_means(df, means, ["bmi", "x"], {"bmi": 10}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 25.0, 4.0), (2, 20.0, 4.0), (3, 30.0, 0.0)]
    scaled = imputation.scale_min_max(df, imputation.fit_ranges(df.filter("id > 1"), ["bmi"]), ["bmi"], -1, 1)
    assert [r.bmi for r in scaled.orderBy("id").collect()] == [-4.0, -1.0, 1.0]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r.v for r in imputation.scale_min_max(flat, imputation.fit_ranges(flat, ["v"]), ["v"]).collect()} == {0.0}
    assert {r.v for r in imputation.scale_z(flat, imputation.fit_moments(flat, ["v"]), ["v"]).collect()} == {0.0}


def test_splits_are_repeatable_and_whole(spark):
    df = spark.range(5000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    train, test = sampling.train_test(df, "id", 0.2)
    assert train.count() + test.count() == 5000 and abs(test.count() - 1000) < 100
    assert train.join(test, "id").count() == 0
    strain, stest = sampling.stratified_train_test(df, "id", "label", 0.25)
    for label, size in ((0, 3750), (1, 1250)):
        assert stest.filter(F.col("label") == label).count() == int(size / 4 + 0.5)
    assert strain.count() + stest.count() == 5000
    once = [r.id for r in sampling.shuffled(df, "id", 1).collect()]
    assert once == [r.id for r in sampling.shuffled(df.repartition(7), "id", 1).collect()]
    assert sorted(once) == list(range(5000)) and once != sorted(once)


def test_mortality_table(spark):
    rows = [(1, 0), (1, 1), (2, 2), (3, 3), (3, -1), (4, -1)]
    got = {r.severity: r for r in summaries.mortality_by_band(spark.createDataFrame(rows, "severity int, detail int")).collect()}
    total = got[None]
    assert (total.n, total.deaths, total.n_icu, total.n_day28, total.n_hospital) == (6, 4, 1, 2, 3)
    assert (total.n_day28_exact, got[1].n_day28, got[1].icu_death_share) == (1, 2, 0.25)


def test_synonyms(spark):
    df = spark.createDataFrame([("HCO3",), ("ETCO2",), ("other",)], "name string")
    assert [r.name for r in joins.rename_synonyms(df, rules.SYNONYMS).collect()] == ["bicarbonate", "etCO2", "other"]


def test_containment_keeps_events_that_end_before_they_begin(spark):
    events = spark.createDataFrame([(1, 20, 0), (1, 50, 0), (1, 5, 9), (1, 5, 10), (1, -1, 3)], "k int, b int, e int")
    windows = spark.createDataFrame([(1, 0, 10)], "k int, lo int, hi int")
    got = joins.contained_join(events, windows, "k", "b", "e", "lo", "hi")
    assert sorted((r.b, r.e) for r in got.collect()) == [(5, 9), (20, 0), (50, 0)]


def test_bootstrap_does_not_depend_on_the_layout(spark):
    df = spark.range(3000)
    one = sorted(r.id for r in sampling.bootstrap(df.repartition(7), "id", 1.0, 3).collect())
    two = sorted(r.id for r in sampling.bootstrap(df.coalesce(1), "id", 1.0, 3).collect())
    assert one == two and abs(len(one) - 3000) < 200 and len(set(one)) < 2100


def test_quantiles_of_a_crowded_band(spark):
    """Very many different values inside one bucket: cut further, counted exactly."""
    n = 300_000
    values = 1000 + np.arange(n) / 1e6
    band = spark.range(n).select(F.lit("band").alias("g"), (F.lit(1000.0) + F.pmod(F.col("id") * 7919, F.lit(n)) / F.lit(1e6)).alias("v"))
    few = spark.createDataFrame([("few", float(i)) for i in range(30)], "g string, v double")
    wanted = {f"p{i}": p for i, p in enumerate((0.0, 0.05, 0.5, 0.999, 1.0))}
    got = {r.g: r for r in distribution.distribution(band.union(few), ["g"], "v", wanted).collect()}
    for name, p in wanted.items():
        assert abs(got["band"][name] - np.quantile(values, p)) < 1e-8
        assert abs(got["few"][name] - np.quantile(np.arange(30.0), p)) < 1e-12
    assert got["band"].n == n and abs(got["band"].var_pop - values.var()) < 1e-9


def test_a_wanted_rank_is_looked_for_in_a_small_piece(spark):
    counts = spark.range(100_000).select(F.lit(1).alias("g"), F.lit(7).cast("bigint").alias("bucket"), F.col("id").cast("double").alias("v"), F.lit(2).cast("bigint").alias("n"))
    bucket = spark.createDataFrame([(1, 7, 100_000, 200_000, 5)], "g int, bucket bigint, distinct bigint, total bigint, base bigint")
    rank = F.lit(100_005)
    rows = distribution._wanted_pieces(counts, bucket, ["g"], lambda size: (F.col("base") <= rank) & (rank < F.col("base") + size)).collect()
    assert len({r.piece for r in rows}) == 1 and 0 < len(rows) < 100_000 / 20
    assert min(r.v for r in rows) <= 50_000 <= max(r.v for r in rows)
