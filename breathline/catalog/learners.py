"""Split search, neighbours, Bayes and Spark ML models on line items, documents and embeddings.

Ensembles and grids have the study's sizes, which are the defaults of
``breathline.learning.models``; all labelled rows are used for fitting.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.catalog.binding import read, rounded
from breathline.learning import kernel_svc as kernel_svcs
from breathline.learning import boosting, evaluation, forest_bags, models, neighbours, splits
from breathline.session import cut_lineage

FOLDS = 5
DOC_FEATURES = ["n_chars", "n_words", "n_lines", "word_length", "digit_share", "upper_share"]
EMBEDDING = [f"e{i}" for i in range(64)]
STUMP_ERROR = 0.05


def labelled_documents(spark, d):
    """Text features of every labelled document, with its quality label."""
    t = F.col("text")
    size = F.greatest(F.length(t), F.lit(1))
    words = F.size(F.split(F.trim(t), r"\s+"))

    def without(characters):
        return F.length(F.translate(t, characters, ""))

    docs = read(spark, d, "documents").select(
        "doc_id",
        F.length(t).cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"),
        F.size(F.split(t, "\n")).cast("double").alias("n_lines"),
        (without(" \t\r\n") / F.greatest(words, F.lit(1))).alias("word_length"),
        ((F.length(t) - without("0123456789")) / size).alias("digit_share"),
        ((F.length(t) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / size).alias("upper_share"),
    )
    labels = read(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = docs.join(labels, "doc_id")
    return rows.withColumn("fold", F.pmod("doc_id", F.lit(FOLDS)).cast("int"))


def embedded(spark, d):
    """Embeddings as an array, as columns, and with a binary label."""
    rows = read(spark, d, "embeddings")
    vector = F.col("embedding").cast("array<double>")
    return rows.select(
        "vec_id", vector.alias("vector"), F.col("label").alias("class"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.pmod("vec_id", F.lit(FOLDS)).cast("int").alias("fold"),
        *[vector[i].alias(c) for i, c in enumerate(EMBEDDING)],
    )


def _priced_lines(spark, d):
    return read(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 100000)


def split_candidates(spark, d):
    rows = splits.stump_candidates(_priced_lines(spark, d), "l_quantity", "y")
    return rounded(rows, 6, "left_mean", "right_mean", "sse")


def best_split_stump(spark, d):
    rows = splits.best_stump(_priced_lines(spark, d), "l_quantity", "y")
    return rounded(rows, 6, "left_mean", "right_mean", "sse")


def boosted_stumps(spark, d):
    """Additive stumps on a curve until the squared error is under STUMP_ERROR of the first; one row per round."""
    lines = read(spark, d, "lineitem").withColumn("y", F.col("l_quantity") * F.col("l_quantity") / 1000)
    start = lines.agg(F.sum(F.col("y") * F.col("y")).alias("q")).first().q or 0.0
    found = splits.boosted_stumps(lines, "l_quantity", "y", error=STUMP_ERROR * start)
    rows = [(i + 1, s.split, s.left, s.right) for i, s in enumerate(found)]
    out = spark.createDataFrame(rows, "round int, split double, left_mean double, right_mean double")
    return rounded(out, 6, "left_mean", "right_mean")


SPLIT_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def best_split_all(spark, d):
    out = splits.best_splits(_priced_lines(spark, d), SPLIT_FEATURES, "y")
    return rounded(out, 6, "sse")


def best_split_per_group(spark, d):
    out = splits.best_splits(_priced_lines(spark, d), SPLIT_FEATURES, "y", ["l_returnflag"])
    return rounded(out, 6, "sse")


def logistic_boosting(spark, d):
    rows = labelled_documents(spark, d)
    model = splits.fit_logistic_boosting(rows, DOC_FEATURES, "label")
    return model.transform(rows).select("doc_id", "label", F.round("score", 9).alias("score"), "prediction")


def gaussian_bayes(spark, d):
    rows = embedded(spark, d).drop("label").withColumnRenamed("class", "label")
    model = models.fit(models.feature_pipeline(EMBEDDING, models.gaussian_bayes(), scale=None), rows)
    scored = model.transform(rows)
    return scored.select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


def _neighbours(spark, d, k):
    return neighbours.out_of_fold_neighbours(embedded(spark, d), "vec_id", "vector", "class", "fold", k)


def knn_vote(spark, d):
    return neighbours.vote(_neighbours(spark, d, 64), models.NEIGHBOUR_KS)


def knn_nearest(spark, d):
    near = _neighbours(spark, d, 3)
    return near.select("query_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


def knn_accuracy_by_k(spark, d):
    votes = neighbours.vote(_neighbours(spark, d, 64), models.NEIGHBOUR_KS)
    out = neighbours.accuracy_by_k(votes, read(spark, d, "embeddings"), "vec_id", "label")
    return rounded(out, 9, "accuracy")


def _doc_scores(spark, d, estimator, **options):
    # the texts are parsed once, for fitting and scoring
    rows = cut_lineage(labelled_documents(spark, d))
    pipeline = models.feature_pipeline(DOC_FEATURES, estimator, **options)
    model = models.fit(pipeline, rows.filter("fold <> 0"))
    return models.score(model, rows, ["doc_id", "fold", "label"])


def gbt_classifier(spark, d):
    return _doc_scores(spark, d, models.gbt_classifier())


def gbt_weighted(spark, d):
    return _doc_scores(spark, d, models.gbt_classifier(maxDepth=3, minInstancesPerNode=3))


def gbt_regressor(spark, d):
    return _doc_scores(spark, d, models.gbt_regressor())


def decision_tree(spark, d):
    return _doc_scores(spark, d, models.tree_classifier())


def random_forest(spark, d):
    return _doc_scores(spark, d, models.forest_classifier())


def forest_regressor(spark, d):
    return _doc_scores(spark, d, models.forest_regressor())


def bagged_trees(spark, d):
    return _doc_scores(spark, d, models.bagged_trees())


def bagged_regressor(spark, d):
    return _doc_scores(spark, d, models.bagged_regressor())


def bagged_forests(spark, d):
    """A bag of 500 forests of 150 trees; the mean of their scores."""
    rows = cut_lineage(labelled_documents(spark, d))
    scored = forest_bags.bag_scores(
        rows, "doc_id", DOC_FEATURES, "label", F.col("fold") != 0, models.BAGS, models.FOREST["numTrees"], math.isqrt(len(DOC_FEATURES)), models.FOREST["maxDepth"]
    )
    return rows.select("doc_id", "label").join(scored, "doc_id").withColumn("prediction", (F.col("score") >= 0.5).cast("double"))


def bag_weight_sums(spark, d):
    """Rows that each of the 500 bags draws, and of how many different ones, from the documents with a label."""
    rows = labelled_documents(spark, d).where("fold <> 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(models.BAGS - 1))).alias("bag"))
    drawn = rows.withColumn("w", forest_bags.bag_weight_column(F.col("doc_id"), F.col("bag")))
    return drawn.groupBy("bag").agg(F.sum("w").alias("drawn"), F.count_if(F.col("w") > 0).alias("different"))


def logistic_regression(spark, d):
    train = labelled_documents(spark, d).filter("fold <> 0").count()
    return _doc_scores(spark, d, models.logistic(n_rows=train), impute=True)


def _vector_scores(spark, d, estimator):
    rows = embedded(spark, d)
    pipeline = models.feature_pipeline(EMBEDDING, estimator)
    return models.out_of_fold_scores(rows, pipeline, "fold", FOLDS, ["vec_id", "label"])


def _training_rows(spark, d) -> int:
    """Vectors outside one fold, which the penalty of a support vector classifier is stated for."""
    return read(spark, d, "embeddings").filter(F.pmod("vec_id", F.lit(FOLDS)) != 0).count()


def linear_svc(spark, d):
    return _vector_scores(spark, d, models.linear_svc(c=0.1, n_rows=_training_rows(spark, d)))


def kernel_svc(spark, d):
    """Out-of-fold values, calibrated scores and classes of an exact RBF classifier."""
    return kernel_svcs.svc_scores(cut_lineage(embedded(spark, d)), "vec_id", "vector", "label", "fold", FOLDS, c=1.0, gamma=0.5)


def _svc_search(spark, d, pairs):
    return kernel_svcs.svc_search(cut_lineage(embedded(spark, d)), "vec_id", "vector", "label", "fold", FOLDS, pairs)


def kernel_svc_search(spark, d):
    """All 25 pairs of C and gamma, solved to a duality gap of 1 %."""
    return _svc_search(spark, d, list(product(models.SVC_GRID["C"], models.SVC_GRID["gamma"])))


def svc_random_search(spark, d):
    """The study's 20 draws: C evenly, gamma log-evenly."""
    draws = models.random_draws(models.SVC_RANGES, models.SEARCH_DRAWS)
    return _svc_search(spark, d, [(x["C"], x["gamma"]) for x in draws])


def svc_gap_closed(spark, d):
    """The search again, as statements that hold for any table: rows scored by each candidate, and whether its gap closed."""
    return kernel_svc_search(spark, d).select("candidate", "C", "gamma", "rows", (F.col("gap") <= 0.01).alias("closed"), F.col("accuracy").between(0, 1).alias("share"))


def stacking(spark, d):
    scored, _ = models.stacked_scores(
        cut_lineage(embedded(spark, d)), "vec_id", "vector", EMBEDDING, "fold", FOLDS, k=50
    )
    return scored


def grid_search(spark, d):
    """All 45 candidates of the boosting grid; a node looks at log2 of the features."""
    grid, each = models.GBT_GRID, int(math.log2(len(DOC_FEATURES)))
    rows = cut_lineage(labelled_documents(spark, d))
    return boosting.boosting_search(rows, "doc_id", DOC_FEATURES, "label", "fold", grid["maxDepth"], grid["stepSize"], grid["maxIter"], features_each=each)


def boosted_weight_search(spark, d):
    """All 144 candidates of the second-order grid, with its floors on summed curvature."""
    grid = models.BOOSTED_WEIGHT_GRID
    rows = cut_lineage(labelled_documents(spark, d))
    return boosting.boosting_search(
        rows, "doc_id", DOC_FEATURES, "label", "fold", grid["maxDepth"], grid["stepSize"], grid["maxIter"], grid["minCurvature"], by_curvature=True, l2=1.0
    )


def search_coverage(spark, d):
    """A search over few rounds: every labelled row is scored out of its fold once by each candidate."""
    rows = cut_lineage(labelled_documents(spark, d))
    found = boosting.boosting_search(rows, "doc_id", DOC_FEATURES, "label", "fold", [2, 3], [0.1, 0.3], [4, 8], [1.0, 2.0], by_curvature=True, l2=1.0)
    return found.select("candidate", "depth", "rate", "rounds", "floor", "rows", F.col("mean").between(0, 1).alias("share"))


def newton_rounds(spark, d):
    """Three rounds of second-order splits on returned lines, binned by curvature anew in each."""
    lines = read(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(boosting.newton_rounds(lines, SPLIT_FEATURES, "y", rounds=3), 6, "gain", "left", "right")


def random_search(spark, d):
    rows = cut_lineage(labelled_documents(spark, d))
    estimator = models.logistic()
    grid = models.random_params(estimator, {"regParam": (1e-4, 1.0), "elasticNetParam": [0.0]}, n=models.SEARCH_DRAWS)
    found = models.cross_validate(models.feature_pipeline(DOC_FEATURES, estimator), grid, rows, "fold", FOLDS)
    return models.search_table(rows, found)


def cross_validated_score(spark, d):
    rows = labelled_documents(spark, d)
    pipeline = models.feature_pipeline(DOC_FEATURES, models.tree_classifier())
    return models.search_table(rows, models.cross_validate(pipeline, [{}], rows, "fold", FOLDS, models.accuracy()))


def tree_summary(spark, d):
    rows = labelled_documents(spark, d)
    model = models.fit(models.feature_pipeline(DOC_FEATURES, models.forest_classifier()), rows)
    return models.tree_summary(rows, model)


def trained_model_compare(spark, d):
    """Out-of-fold AUC, KS and accuracy of four fitted models."""
    rows = cut_lineage(labelled_documents(spark, d))
    candidates = {
        "tree": models.tree_classifier(),
        "forest": models.forest_classifier(),
        "bayes": models.gaussian_bayes(),
        "logistic": models.logistic(n_rows=rows.count()),
    }
    parts = [
        models.out_of_fold_scores(rows, models.feature_pipeline(DOC_FEATURES, e), "fold", FOLDS, ["label"])
        .withColumn("model", F.lit(name))
        for name, e in candidates.items()
    ]
    return rounded(evaluation.compare_models(reduce(DataFrame.unionByName, parts)), 6, "auc", "ks", "accuracy")


QUERIES = {
    f.__name__: f
    for f in (
        split_candidates, best_split_stump, boosted_stumps, best_split_all, best_split_per_group,
        logistic_boosting, gaussian_bayes, knn_vote, knn_nearest, knn_accuracy_by_k, gbt_classifier, gbt_weighted,
        gbt_regressor, decision_tree, random_forest, forest_regressor, bagged_trees, bagged_regressor,
        bagged_forests, bag_weight_sums, logistic_regression, linear_svc, kernel_svc, kernel_svc_search, svc_random_search, svc_gap_closed, stacking, grid_search,
        boosted_weight_search, search_coverage, newton_rounds, random_search, cross_validated_score, tree_summary, trained_model_compare,
    )
}


def _sql_round(source: str, i: int) -> str:
    """Candidates and best stump of one round over (x, n, s, q), then the sums after it."""
    return f"""c{i} AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER w AS ln, sum(s) OVER w AS ls,
  sum(q) OVER w AS lq, sum(n) OVER () AS tn, sum(s) OVER () AS ts, sum(q) OVER () AS tq FROM {source}
  WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
k{i} AS (SELECT (x + nx) / 2 AS split, ls / ln AS left_mean, (ts - ls) / (tn - ln) AS right_mean,
  (lq - ls * ls / ln) + ((tq - lq) - (ts - ls) * (ts - ls) / (tn - ln)) AS sse FROM c{i} WHERE nx IS NOT NULL),
b{i} AS (SELECT * FROM k{i} ORDER BY sse, split LIMIT 1),
v{i} AS (SELECT x, n, s - n * f AS s, q - 2 * f * s + n * f * f AS q FROM (
  SELECT v.*, CASE WHEN x < split THEN left_mean ELSE right_mean END AS f FROM {source} v, b{i}))"""


_V0 = """WITH v0 AS (SELECT l_quantity AS x, count(*) AS n, sum(l_extendedprice / 100000) AS s,
  sum((l_extendedprice / 100000) * (l_extendedprice / 100000)) AS q FROM lineitem GROUP BY 1)"""
_STUMP = "split, round(left_mean, 6) AS left_mean, round(right_mean, 6) AS right_mean"


def _sql_boosted(rounds: int) -> str:
    """As many rounds as may be needed; a round counts while the error before it is not yet under the limit."""
    steps = ",\n".join(_sql_round(f"v{i}", i + 1) for i in range(rounds))
    limit = f"(SELECT {STUMP_ERROR} * sum(q) FROM v0)"
    parts = [f"SELECT CAST(1 AS INTEGER) AS round, {_STUMP} FROM b1"] + [
        f"SELECT {i}, {_STUMP} FROM b{i} WHERE (SELECT sse FROM b{i - 1}) >= {limit}" for i in range(2, rounds + 1)
    ]
    curve = "l_quantity * l_quantity / 1000"
    first = f"WITH v0 AS (SELECT l_quantity AS x, count(*) AS n, sum({curve}) AS s, sum(({curve}) * ({curve})) AS q FROM lineitem GROUP BY 1)"
    return first + ",\n" + steps + "\n" + " UNION ALL ".join(parts)


def _sql_best(key: str = "") -> str:
    by = f"{key}, " if key else ""
    long = " UNION ALL ".join(
        f"SELECT {by}{i} AS no, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, l_extendedprice / 100000 AS y FROM lineitem"
        for i, f in enumerate(SPLIT_FEATURES)
    )
    choose = f"PARTITION BY {key} " if key else ""
    return f"""WITH l AS ({long}),
v AS (SELECT {by}no, feature, x, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM l GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(q) OVER w AS lq, sum(n) OVER t AS tn,
  sum(s) OVER t AS ts, sum(q) OVER t AS tq FROM v
  WINDOW w AS (PARTITION BY {by}feature ORDER BY x ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY {by}feature)),
e AS (SELECT *, tn - ln AS rn, (lq - ls * ls / ln) + ((tq - lq) - (ts - ls) * (ts - ls) / (tn - ln)) AS sse
  FROM c WHERE ln >= 2 AND tn - ln >= 2)
SELECT {by}feature, x AS split, round(sse, 6) AS sse, CAST(ln AS BIGINT) AS n_left, CAST(rn AS BIGINT) AS n_right
FROM e WHERE sse < tq - ts * ts / tn QUALIFY row_number() OVER ({choose}ORDER BY sse, no, x) = 1"""


def _sql_newton(rounds: int) -> str:
    """Best second-order split of each round; a feature of up to 64 values is cut behind each of them."""
    ctes = ["""l0 AS (SELECT *, (l_returnflag = 'R')::INT AS y, ln(m / (1 - m)) AS f FROM lineitem,
  (SELECT avg((l_returnflag = 'R')::INT) AS m FROM lineitem))"""]
    for i in range(1, rounds + 1):
        long = " UNION ALL ".join(f"SELECT {k} AS no, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, p - y AS g, p * (1 - p) AS h FROM p{i}" for k, c in enumerate(SPLIT_FEATURES))
        ctes += [
            f"p{i} AS (SELECT *, 1 / (1 + exp(-f)) AS p FROM l{i - 1})",
            f"s{i} AS (SELECT no, feature, x, sum(g) AS g, sum(h) AS h FROM ({long}) GROUP BY ALL)",
            f"""w{i} AS (SELECT no, feature, x, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER a AS g, sum(h) OVER a AS h FROM s{i}
  WINDOW o AS (PARTITION BY no ORDER BY x), a AS (PARTITION BY no))""",
            f"""b{i} AS (SELECT feature, x AS split, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain,
  -gl / (hl + 1) AS lv, -(g - gl) / (h - hl + 1) AS rv FROM w{i} WHERE hl >= 1 AND h - hl >= 1 ORDER BY gain DESC, no, x LIMIT 1)""",
            f"""l{i} AS (SELECT l.* REPLACE (l.f + 0.3 * CASE WHEN CASE b.feature {' '.join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in SPLIT_FEATURES)} END <= b.split
  THEN b.lv ELSE b.rv END AS f) FROM l{i - 1} l, b{i} b)""",
        ]
    parts = [f"SELECT CAST({i} AS INTEGER) AS round, feature, split, round(gain, 6) AS gain, round(lv, 6) AS \"left\", round(rv, 6) AS \"right\" FROM b{i}" for i in range(1, rounds + 1)]
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(parts)


def _sql_bag_weights() -> str:
    """The draws of ``forest_bags`` in whole numbers."""
    steps, modulus, factor = forest_bags.STEPS, forest_bags.MODULUS, forest_bags.FACTOR
    source = f"SELECT bag, (CAST(doc_id AS BIGINT) * {steps[0]} + CAST(bag AS BIGINT) * {steps[1]}) % {modulus} AS x FROM l, b"
    for _ in range(4):
        source = f"SELECT bag, ((x + 1) * {factor} + x % 1021 * {steps[1]}) % {modulus} AS x FROM ({source})"
    weight = " + ".join(f"CAST((x + 0.5) / {modulus} > {p!r} AS BIGINT)" for p in forest_bags.POISSON)
    return f"""WITH l AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE doc_id % {FOLDS} <> 0),
b AS (SELECT CAST(unnest(range({models.BAGS})) AS INTEGER) AS bag), w AS (SELECT bag, {weight} AS w FROM ({source}))
SELECT bag, CAST(sum(w) AS BIGINT) AS drawn, CAST(count(*) FILTER (w > 0) AS BIGINT) AS different FROM w GROUP BY 1"""


_NEAR = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, vec_id % 5 AS fold FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, b.label, list_distance(a.v, b.v) AS distance
  FROM e a JOIN e b ON a.fold <> b.fold),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)"""

_VOTE = f"""{_NEAR},
k AS (SELECT CAST(unnest(range(50, 65)) AS INTEGER) AS k),
n AS (SELECT query_id, k, label, count(*) AS n FROM r JOIN k ON rank <= k GROUP BY ALL),
v AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY n DESC, label) = 1)"""

SQL = {
    "svc_gap_closed": f"""SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INTEGER) AS candidate, c AS "C", g AS gamma,
  (SELECT count(*) FROM embeddings) AS rows, true AS closed, true AS share
FROM (SELECT unnest({[float(c) for c in models.SVC_GRID["C"]]})::DOUBLE AS c, unnest(range(5)) AS i),
  (SELECT unnest({[float(g) for g in models.SVC_GRID["gamma"]]})::DOUBLE AS g, unnest(range(5)) AS j)""",
    "bag_weight_sums": _sql_bag_weights(),
    "newton_rounds": _sql_newton(3),
    "search_coverage": """SELECT CAST(row_number() OVER (ORDER BY depth, rounds, rate, floor) - 1 AS INTEGER) AS candidate, depth, rate, rounds, floor,
  (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS rows, true AS share
FROM (SELECT CAST(unnest([2, 3]) AS INTEGER) AS depth), (SELECT CAST(unnest([0.1, 0.3]) AS DOUBLE) AS rate),
  (SELECT CAST(unnest([4, 8]) AS INTEGER) AS rounds), (SELECT CAST(unnest([1, 2]) AS DOUBLE) AS floor)""",
    "split_candidates": f"{_V0},\n{_sql_round('v0', 1)}\nSELECT {_STUMP}, round(sse, 6) AS sse FROM k1",
    "best_split_stump": f"{_V0},\n{_sql_round('v0', 1)}\nSELECT {_STUMP}, round(sse, 6) AS sse FROM b1",
    "boosted_stumps": _sql_boosted(6),
    "best_split_all": _sql_best(),
    "best_split_per_group": _sql_best("l_returnflag"),
    "gaussian_bayes": """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
eps AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(v) AS s FROM x GROUP BY i)),
st AS (SELECT label AS c, i, avg(v) AS mu, var_pop(v) + any_value(e) AS s FROM x, eps GROUP BY 1, 2),
pr AS (SELECT label AS c, ln(count(*) / (SELECT count(*) FROM embeddings)) AS lp FROM embeddings GROUP BY 1),
ll AS (SELECT vec_id, c, any_value(label) AS label, sum(-0.5 * ln(2 * pi() * s) - (v - mu) * (v - mu) / (2 * s)) AS l
  FROM x JOIN st USING (i) GROUP BY 1, 2)
SELECT vec_id, label, c AS prediction FROM ll JOIN pr USING (c)
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY l + lp DESC) = 1""",
    "knn_vote": f"{_VOTE}\nSELECT query_id, k, label AS prediction FROM v",
    "knn_accuracy_by_k": f"""{_VOTE}
SELECT k, CAST(sum(CAST(v.label = e.label AS INTEGER)) AS BIGINT) AS hits,
  round(avg(CAST(v.label = e.label AS INTEGER)), 9) AS accuracy FROM v JOIN e ON query_id = vec_id GROUP BY 1""",
    "knn_nearest": f"""{_NEAR}
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(distance, 6) AS distance FROM r WHERE rank <= 3""",
}
