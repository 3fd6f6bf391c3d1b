"""Evaluation queries: label and scores derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.catalog.binding import read, rounded
from breathline.learning import evaluation

LINE_SCORE = "(floor(l_extendedprice / 100) / 2000 + l_discount + (CASE WHEN l_returnflag = 'R' THEN 0.05 ELSE 0 END))"


def scored_lines(spark, d):
    """(key, fold, label, score): a score with ties that is higher for returned lines."""
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.expr(LINE_SCORE).alias("score"),
    )


def _predicted(spark, d):
    return scored_lines(spark, d).withColumn("prediction", (F.col("score") >= 0.3).cast("int"))


def roc_points(spark, d):
    points = evaluation.roc_points(scored_lines(spark, d))
    return rounded(points.select("threshold", "tp", "fp", "tpr", "fpr"), 9, "tpr", "fpr")


def auc_ks(spark, d):
    return rounded(evaluation.auc_and_ks(scored_lines(spark, d)), 9, "auc", "ks")


def auc_ks_per_fold(spark, d):
    return rounded(evaluation.auc_and_ks(scored_lines(spark, d), ["fold"]), 9, "auc", "ks")


def confusion(spark, d):
    return evaluation.confusion_matrix(_predicted(spark, d))


def classification_metrics(spark, d):
    out = evaluation.classification_metrics(_predicted(spark, d), keys=["fold"])
    ratios = ["accuracy", "sensitivity", "specificity", "ppv", "f1", "tpr", "fpr"]
    return rounded(out, 9, *ratios)


def regression_metrics(spark, d):
    out = evaluation.regression_metrics(scored_lines(spark, d), "label", "score", ["fold"])
    return rounded(out, 9, "mse", "rmse", "mae", "r2")


def mean_roc(spark, d):
    points = evaluation.roc_points(scored_lines(spark, d), ["fold"])
    return rounded(evaluation.mean_roc(points), 8, "fpr", "tpr", "lower", "upper")


def mean_roc_area(spark, d):
    points = evaluation.roc_points(scored_lines(spark, d), ["fold"])
    return rounded(evaluation.mean_auc(evaluation.mean_roc(points)), 8, "mean_auc")


MODEL_SCORES = {
    "price": "floor(l_extendedprice / 110) / 1000",
    "discount": "l_discount * 10",
    "quantity": "l_quantity / 50",
    "mixed": "l_quantity / 100 + l_discount * 5",
}


def model_compare(spark, d):
    lines = read(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label")
    # one scan makes the scores of all models
    models = ", ".join(f"'{name}', CAST({rule} AS DOUBLE)" for name, rule in MODEL_SCORES.items())
    scored = lines.select(label, F.expr(f"stack({len(MODEL_SCORES)}, {models}) AS (model, score)"))
    out = evaluation.compare_models(scored)
    return rounded(out, 9, "auc", "ks", "accuracy", "sensitivity", "specificity")


QUERIES = {
    f.__name__: f
    for f in (
        roc_points, auc_ks, auc_ks_per_fold, confusion, classification_metrics, regression_metrics,
        mean_roc, mean_roc_area, model_compare,
    )
}

_S = f"""WITH s AS (SELECT l_orderkey AS key, CAST(l_orderkey % 5 AS INTEGER) AS fold,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, {LINE_SCORE} AS score FROM lineitem)"""
_P = f"{_S},\np AS (SELECT *, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS prediction FROM s)"


def _sql_curve(keys: str = "", source: str = "s") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""c AS (SELECT {cols}score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM {source} GROUP BY {cols}score),
r AS (SELECT {cols}score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  sum(pos) OVER ({part}) AS ap, sum(neg) OVER ({part}) AS an FROM c
  WINDOW w AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


_AREA = """round(CAST(sum(neg * (tp - pos + pos / 2)) AS DOUBLE) / max(CAST(ap AS DOUBLE) * an), 9) AS auc,
  round(greatest(0, max(CAST(tp AS DOUBLE) / ap - CAST(fp AS DOUBLE) / an)), 9) AS ks"""

_MEAN = f"""{_S},
{_sql_curve('fold')},
pts AS (SELECT fold, fp, tp, ap, an FROM r UNION ALL SELECT DISTINCT fold, 0, 0, ap, an FROM r),
g AS (SELECT unnest(range(0, 100)) AS g),
folds AS (SELECT DISTINCT fold, ap, an FROM r),
lo AS (SELECT f.fold, g.g, f.ap, f.an, max(struct_pack(fp := p.fp, tp := p.tp)) AS low FROM folds f, g, pts p
  WHERE p.fold = f.fold AND p.fp * 99 <= g.g * f.an GROUP BY ALL),
hi AS (SELECT f.fold, g.g, min(struct_pack(fp := p.fp, tp := p.tp)) AS high FROM folds f, g, pts p
  WHERE p.fold = f.fold AND p.fp * 99 > g.g * f.an GROUP BY ALL),
curve AS (SELECT fold, g, CASE WHEN g = 0 THEN 0.0 ELSE (low.tp + coalesce((CAST(g AS DOUBLE) / 99 * an - low.fp)
  / (high.fp - low.fp) * (high.tp - low.tp), 0)) / ap END AS tpr FROM lo LEFT JOIN hi USING (fold, g)),
band AS (SELECT g, CAST(g AS DOUBLE) / 99 AS x, CASE WHEN g = 99 THEN 1.0 ELSE avg(tpr) END AS m,
  stddev_pop(tpr) AS sd FROM curve GROUP BY 1)"""

SQL = {
    "roc_points": f"""{_S},
{_sql_curve()}
SELECT score AS threshold, tp, fp, round(CAST(tp AS DOUBLE) / ap, 9) AS tpr, round(CAST(fp AS DOUBLE) / an, 9) AS fpr FROM r""",
    "auc_ks": f"{_S},\n{_sql_curve()}\nSELECT {_AREA} FROM r",
    "auc_ks_per_fold": f"{_S},\n{_sql_curve('fold')}\nSELECT fold, {_AREA} FROM r GROUP BY fold",
    "confusion": f"{_P}\nSELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2",
    "classification_metrics": f"""{_P},
k AS (SELECT fold, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM p GROUP BY 1)
SELECT fold, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
  round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity,
  round(tp / (tp + fp), 9) AS ppv, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
  round(tp / (tp + fn), 9) AS tpr, round(fp / (fp + tn), 9) AS fpr FROM k""",
    "regression_metrics": f"""{_S}
SELECT fold, round(avg((label - score) ** 2), 9) AS mse, round(sqrt(avg((label - score) ** 2)), 9) AS rmse,
  round(avg(abs(label - score)), 9) AS mae, round(1 - avg((label - score) ** 2) / var_pop(label), 9) AS r2
FROM s GROUP BY 1""",
    "mean_roc": f"""{_MEAN}
SELECT CAST(g AS INTEGER) AS g, round(x, 8) AS fpr, round(m, 8) AS tpr, round(greatest(m - sd, 0), 8) AS lower,
  round(least(m + sd, 1), 8) AS upper FROM band""",
    "mean_roc_area": f"""{_MEAN}
SELECT round(sum(a), 8) AS mean_auc FROM (SELECT (x - lag(x) OVER (ORDER BY g)) * (m + lag(m) OVER (ORDER BY g)) / 2
  AS a FROM band)""",
    "model_compare": "WITH s AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, {r} AS score FROM lineitem"
        for n, r in MODEL_SCORES.items()
    )
    + f"""),
{_sql_curve('model')},
a AS (SELECT model, {_AREA} FROM r GROUP BY 1),
k AS (SELECT model, round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
  round(count(*) FILTER (label = 1 AND score >= 0.5) / count(*) FILTER (label = 1), 9) AS sensitivity,
  round(count(*) FILTER (label = 0 AND score < 0.5) / count(*) FILTER (label = 0), 9) AS specificity
  FROM s GROUP BY 1)
SELECT * FROM a JOIN k USING (model)""",
}
