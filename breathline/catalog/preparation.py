"""Imputation, scaling, distribution and sampling queries."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from breathline.catalog.binding import events_long, read, rounded, sql_events, sql_half_even
from breathline.operators import distribution, imputation, sampling

TYPES = ["click", "error", "purchase", "signup", "view"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _daily(spark, d):
    """Largest value per (stay, day) and event type; days without an event have gaps."""
    rows = events_long(spark, d).withColumn("day", F.floor(F.col("offset_min") / 1440))
    return rows.groupBy("stay_id", "day").pivot("name", TYPES).agg(F.max("value"))


def impute_mean(spark, d):
    daily = _daily(spark, d)
    means = imputation.fit_means(daily, TYPES, {"click": 10, "view": 10})
    return imputation.impute_means(daily, means, TYPES, {"click": 10, "view": 10})


def impute_zero(spark, d):
    return imputation.impute_zero(_daily(spark, d), TYPES)


def impute_group(spark, d):
    return imputation.impute_group_means(_daily(spark, d), "stay_id", ["click", "view"])


def _lines(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", *MEASURES)


def scale_minmax(spark, d):
    rows = _lines(spark, d)
    out = imputation.scale_min_max(rows, imputation.fit_ranges(rows, MEASURES), MEASURES, -1.0, 1.0)
    return rounded(out, 9, *MEASURES)


def scale_minmax_train_only(spark, d):
    """Ranges of returned lines applied to every line: values may leave [0, 1]."""
    rows = read(spark, d, "lineitem")
    ranges = imputation.fit_ranges(rows.filter("l_returnflag = 'R'"), ["l_extendedprice"])
    out = imputation.scale_min_max(rows.select("l_orderkey", "l_extendedprice"), ranges, ["l_extendedprice"])
    return rounded(out, 9, "l_extendedprice")


def zscore(spark, d):
    rows = _lines(spark, d)
    return rounded(imputation.scale_z(rows, imputation.fit_moments(rows, MEASURES), MEASURES), 7, *MEASURES)


def zscore_inverse(spark, d):
    rows = _lines(spark, d)
    moments = imputation.fit_moments(rows, MEASURES)
    back = imputation.unscale_z(imputation.scale_z(rows, moments, MEASURES), moments, {m: m for m in MEASURES})
    return rounded(back, 4, *MEASURES)


def decimal_scale(spark, d):
    rows = _lines(spark, d)
    out = imputation.scale_decimal(rows, imputation.fit_magnitudes(rows, MEASURES), MEASURES)
    return rounded(out, 9, *MEASURES)


def normal_fit_curve(spark, d):
    """Densities of order prices: both deviations, over one grid."""
    price = read(spark, d, "orders").withColumn("v", F.when(F.col("o_totalprice") > 5000, F.col("o_totalprice") / 5000))
    parts = [
        distribution.density_curve(distribution.normal_fit(price, "v", sample, missing), 10, 100, 0.5)
        .withColumn("kind", F.lit(kind))
        for kind, sample, missing in (("mle", False, 90), ("sample", True, 0))
    ]
    return rounded(parts[0].unionByName(parts[1]), 10, "density")


def box_stats(spark, d):
    return rounded(distribution.box_statistics(read(spark, d, "orders"), "o_totalprice"), 6, "q1", "q2", "q3")


def box_stats_by_group(spark, d):
    rows = read(spark, d, "events").select("event_type", "value")
    return rounded(distribution.box_statistics(rows, "value", ["event_type"]), 6, "q1", "q2", "q3")


def exact_quantiles(spark, d):
    """Quantiles, mean and variance per group, negative values included."""
    rows = read(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    out = distribution.distribution(
        rows, ["c_mktsegment"], "c_acctbal", {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    )
    return rounded(rounded(out, 5, "p05", "p50", "p95"), 3, "mean", "var_pop")


def split_folds(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", sampling.fold_number(F.col("o_orderkey")).alias("fold"))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))


def train_test_sizes(spark, d):
    """Sizes of plain and exactly stratified splits."""
    docs = read(spark, d, "documents").select("doc_id", "lang")
    plain = sampling.train_test(docs, "doc_id", 0.2)
    strata = sampling.stratified_train_test(docs, "doc_id", "lang", 0.25)
    sides = zip(("train", "test"), plain, strata, strict=True)
    parts = [
        frame.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), F.lit(side).alias("side"), "lang", "n"
        )
        for side, a, b in sides
        for kind, frame in (("plain", a), ("stratified", b))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shuffled_rows(spark, d):
    return sampling.shuffled(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


def bootstrap_sample(spark, d):
    return sampling.bootstrap(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 0.8, 1)


def pca_project(spark, d):
    rows = read(spark, d, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    parts = vector_to_array("components")
    return sampling.principal_components(rows).select("vec_id", parts[0].alias("first"), parts[1].alias("second"))


QUERIES = {
    f.__name__: f
    for f in (
        impute_mean, impute_zero, impute_group, scale_minmax, scale_minmax_train_only, zscore,
        zscore_inverse, decimal_scale, normal_fit_curve, box_stats, box_stats_by_group, exact_quantiles,
        split_folds, train_test_sizes, shuffled_rows, bootstrap_sample, pca_project,
    )
}



def _sql_share(key: str, seed: int) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0)"


def _sql_poisson(share: str, rate: float) -> str:
    term, total, steps = math.exp(-rate), 0.0, []
    for count in range(40):
        total += term
        steps.append(f"CAST({share} >= {total!r} AS INTEGER)")
        term *= rate / (count + 1)
    return " + ".join(steps)


_DAILY = f"""WITH {sql_events()},
daily AS (SELECT stay_id, CAST(offset_min // 1440 AS BIGINT) AS day,
  {', '.join(f"max(value) FILTER (name = '{t}') AS {t}" for t in TYPES)} FROM m GROUP BY 1, 2)"""
_LIMITED = ("click", "view")


def _sql_mean(t: str) -> str:
    valid = f"{t} > 10" if t in _LIMITED else f"{t} <> 0"
    return f"(SELECT {sql_half_even(f'avg({t}) FILTER ({valid})', 3)} FROM daily)"


def _sql_filled(t: str) -> str:
    kept = f"CASE WHEN {t} > 10 THEN {t} END" if t in _LIMITED else t
    return f"coalesce({kept}, {_sql_mean(t)}) AS {t}"


def _sql_box(value: str, source: str, key: str = "") -> str:
    by, group = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    join = f"USING ({key})" if key else "ON true"
    return f"""WITH q AS (SELECT {by}count(*) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2,
  quantile_cont({value}, 0.75) AS q3 FROM {source} {group})
SELECT {by}any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS q2, round(any_value(q3), 6) AS q3,
  min({value}) FILTER ({value} >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max({value}) FILTER ({value} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER ({value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM {source} JOIN q {join} {group}"""


def _per_measure(template: str) -> str:
    return ", ".join(template.format(m=m) + f" AS {m}" for m in MEASURES)


SQL = {
    "train_test_sizes": f"""WITH p AS (SELECT doc_id, lang, {_sql_share('doc_id', 123)} < 0.2 AS test FROM documents),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY {_sql_share('doc_id', 1)}, doc_id) AS no,
  round(count(*) OVER (PARTITION BY lang) * 0.25) AS wanted FROM documents)
SELECT 'plain' AS kind, CASE WHEN test THEN 'test' ELSE 'train' END AS side, lang, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT 'stratified', CASE WHEN no <= wanted THEN 'test' ELSE 'train' END, lang, count(*) FROM r GROUP BY ALL""",
    "bootstrap_sample": f"""SELECT vec_id, label FROM (
  SELECT vec_id, label, unnest(range({_sql_poisson(_sql_share('vec_id', 1), 0.8)})) FROM embeddings)""",
    "impute_mean": f"{_DAILY}\nSELECT stay_id, day, {', '.join(_sql_filled(t) for t in TYPES)} FROM daily",
    "impute_zero": f"{_DAILY}\nSELECT stay_id, day, {', '.join(f'coalesce({t}, 0) AS {t}' for t in TYPES)} FROM daily",
    "impute_group": f"""{_DAILY},
g AS (SELECT stay_id, {sql_half_even('avg(click)', 1)} AS c, {sql_half_even('avg(view)', 1)} AS v FROM daily GROUP BY 1)
SELECT stay_id, day, coalesce(nullif(click, 0), c) AS click, error, purchase, signup,
  coalesce(nullif(view, 0), v) AS view FROM daily JOIN g USING (stay_id)""",
    "scale_minmax": f"""WITH r AS (SELECT {', '.join(f'min({m}) AS lo_{m}, max({m}) AS hi_{m}' for m in MEASURES)} FROM lineitem)
SELECT l_orderkey, {_per_measure('round(({m} - lo_{m}) / (hi_{m} - lo_{m}) * 2 - 1, 9)')} FROM lineitem, r""",
    "scale_minmax_train_only": """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem
  WHERE l_returnflag = 'R') SELECT l_orderkey, round((l_extendedprice - lo) / (hi - lo), 9) AS l_extendedprice FROM lineitem, r""",
    "zscore": f"""WITH r AS (SELECT {', '.join(f'avg({m}) AS a_{m}, stddev_pop({m}) AS s_{m}' for m in MEASURES)} FROM lineitem)
SELECT l_orderkey, {_per_measure('round(({m} - a_{m}) / s_{m}, 7)')} FROM lineitem, r""",
    "zscore_inverse": f"SELECT l_orderkey, {_per_measure('round({m}, 4)')} FROM lineitem",
    "decimal_scale": f"""WITH r AS (SELECT {', '.join(f'ceil(log10(max(abs({m})))) AS k_{m}' for m in MEASURES)} FROM lineitem)
SELECT l_orderkey, {_per_measure('round({m} / pow(10, k_{m}), 9)')} FROM lineitem, r""",
    "normal_fit_curve": """WITH p AS (SELECT CASE WHEN o_totalprice > 5000 THEN o_totalprice / 5000 END AS v FROM orders),
f AS (SELECT 'mle' AS kind, avg(coalesce(v, 90)) AS mu, stddev_pop(coalesce(v, 90)) AS sigma FROM p
  UNION ALL SELECT 'sample', avg(coalesce(v, 0)), stddev_samp(coalesce(v, 0)) FROM p),
g AS (SELECT CAST(unnest(range(0, 181)) AS INTEGER) AS i)
SELECT i, CAST(10 + i * 0.5 AS DOUBLE) AS x,
  round(exp(-pow((10 + i * 0.5 - mu) / sigma, 2) / 2) / (sigma * sqrt(2 * pi())), 10) AS density, kind FROM f, g""",
    "box_stats": _sql_box("o_totalprice", "orders"),
    "box_stats_by_group": _sql_box("value", "events", "event_type"),
    "exact_quantiles": """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 3) AS mean, round(var_pop(c_acctbal), 3) AS var_pop,
  min(c_acctbal) AS min_value, max(c_acctbal) AS max_value, round(quantile_cont(c_acctbal, 0.05), 5) AS p05,
  round(quantile_cont(c_acctbal, 0.5), 5) AS p50, round(quantile_cont(c_acctbal, 0.95), 5) AS p95
FROM customer GROUP BY 1""",
    "shuffled_rows": "SELECT o_orderkey FROM orders",
    "split_folds": """SELECT CAST(o_orderkey % 5 AS INTEGER) AS fold, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY 1""",
}
