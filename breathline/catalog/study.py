"""The study's two long paths on the driver's tables: the feature table of all relations, and fitted folds with their curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from breathline.catalog.binding import INSPIRED, ORIGIN, OXYGEN, read, rounded, sql_events, sql_half_even, sql_pairs
from breathline.catalog.evaluation import _AREA, _MEAN, _S, _sql_curve
from breathline.catalog.timeseries import _sql_stats
from breathline.functions import rules
from breathline.learning import evaluation, models
from breathline.plans.evaluation import held_out_scores
from breathline.plans.features import dynamic_measurements, feature_table
from breathline.session import cut_lineage

FOLDS = 5
WINDOW = 10_080

# The bound relations as projections that Spark and DuckDB read alike.
EVENT_NAMES = (
    f"CASE event_type WHEN '{OXYGEN}' THEN '{rules.PAO2}' WHEN '{INSPIRED}' THEN '{rules.FIO2}' "
    "WHEN 'signup' THEN 'bedside glucose' WHEN 'click' THEN 'HCO3' ELSE 'Methemoglobin' END"
)
ADMISSION = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'CABG with valve repair' WHEN 'AUTOMOBILE' THEN 'Sepsis, pulmonary' "
    "WHEN 'MACHINERY' THEN 'mitral valve' WHEN 'HOUSEHOLD' THEN 'Pneumonia, other' END"
)
PLACES = ["Emergency Department", "Operating Room", "Floor", "Direct Admit", "another hospital"]
PLACE = "CASE c_nationkey % 5 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLACES)) + " END"
AGE = "CASE WHEN c_acctbal > 9000 THEN '> 89' ELSE CAST(c_custkey % 89 AS {string}) END"
WEIGHT = "CAST(50 + c_custkey % 60 AS DOUBLE)"
HEIGHT = "CAST(CASE c_custkey % 3 WHEN 0 THEN 1.8 WHEN 1 THEN 175 ELSE 0 END AS DOUBLE)"
CHARTED = "CASE o_orderstatus WHEN 'F' THEN 'Heart Rate' WHEN 'O' THEN 'GCS Total' ELSE 'Weight' END"
CHART_TEXT = (
    "CASE o_orderpriority WHEN '5-LOW' THEN 'n/a' WHEN '4-NOT SPECIFIED' THEN 'about 9' "
    "ELSE CAST(CAST(floor(o_totalprice / 1000) AS INT) AS {string}) END"
)
BREATH_TEXT = "CAST(CAST(floor(c_acctbal / 100) AS INT) AS {string})"
ADMISSION_DRUG = "CASE c_mktsegment WHEN 'BUILDING' THEN 'HEPARIN SODIUM' WHEN 'MACHINERY' THEN 'MILRINONE' ELSE 'ASPIRIN' END"
GIVEN_DRUG = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'warfarin' WHEN '2-HIGH' THEN 'DOPamine' "
    "WHEN '3-MEDIUM' THEN 'Norepinephrine 4 mg' WHEN '4-NOT SPECIFIED' THEN 'VASOPRESSIN 20' ELSE 'aspirin' END"
)
TREATMENT = "CASE o_orderstatus WHEN 'P' THEN 'cardiovascular|vasopressors' ELSE 'renal' END"
STAY = "patientunitstayid"


def _relations(spark, d):
    """The clinical relations that the feature table reads, drawn from the driver's tables."""
    customer, orders = read(spark, d, "customer"), read(spark, d, "orders")
    events, lines = read(spark, d, "events"), read(spark, d, "lineitem")
    day = f"date_diff(to_date(ts), DATE '{ORIGIN}')"
    return {
        "lab": events.selectExpr(
            f"user_id AS {STAY}", f"{EVENT_NAMES} AS labname", "value AS labresult",
            f"{day} * 1440 + hour(ts) * 60 + minute(ts) AS labresultoffset",
        ),
        "customlab": orders.filter("o_orderpriority = '1-URGENT'").selectExpr(
            f"o_custkey AS {STAY}", "'PIP (cmH2O)' AS labothername",
            "CAST(CAST(floor(o_totalprice / 9000) AS INT) AS STRING) AS labotherresult", "CAST(o_orderkey % 5760 AS INT) AS labotheroffset",
        ),
        "nursecharting": orders.selectExpr(
            f"o_custkey AS {STAY}", f"{CHARTED} AS nursingchartcelltypevalname", f"{CHART_TEXT.format(string='STRING')} AS nursingchartvalue",
            "CAST(o_orderkey % 5760 AS INT) AS nursingchartoffset",
        ),
        "respiratorycharting": customer.selectExpr(
            f"c_custkey AS {STAY}", "'EtCO2' AS respchartvaluelabel", f"{BREATH_TEXT.format(string='STRING')} AS respchartvalue",
            "c_nationkey * 100 AS respchartoffset",
        ),
        "vitalperiodic": lines.selectExpr(
            f"l_suppkey AS {STAY}", "CAST(l_partkey % 5000 AS INT) AS observationoffset", "l_quantity AS padiastolic",
            "l_quantity + 40 AS pasystolic", "l_tax * 100 AS pamean", "CAST(NULL AS DOUBLE) AS cvp",
        ),
        "apacheapsvar": customer.selectExpr(f"c_custkey AS {STAY}", "c_acctbal AS hematocrit"),
        "admissiondrug": customer.selectExpr(
            f"c_custkey AS {STAY}", f"{ADMISSION_DRUG} AS drugname", "CAST((c_custkey * 37) % 20000 AS INT) AS drugenteredoffset"
        ),
        "medication": orders.selectExpr(
            f"o_custkey AS {STAY}", f"{GIVEN_DRUG} AS drugname", "CAST(o_orderkey % 9000 AS INT) AS drugstartoffset",
            "CAST(o_orderkey % 9000 + floor(o_totalprice / 100) AS INT) AS drugstopoffset",
        ),
        "treatment": orders.selectExpr(
            f"o_custkey AS {STAY}", f"{TREATMENT} AS treatmentstring", "CAST(o_orderkey % 20000 AS INT) AS treatmentoffset"
        ),
        "patient": customer.selectExpr(
            f"c_custkey AS {STAY}", f"{AGE.format(string='STRING')} AS age", "CASE c_custkey % 2 WHEN 1 THEN 'Female' ELSE 'Male' END AS gender",
            f"{PLACE} AS hospitaladmitsource", f"{WEIGHT} AS admissionweight", f"{HEIGHT} AS admissionheight", f"{ADMISSION} AS apacheadmissiondx",
        ),
        "apachepatientresult": customer.selectExpr(f"c_custkey AS {STAY}", "CAST(floor(c_acctbal / 100) AS INT) AS apachescore"),
    }


def combined_extraction(spark, d):
    """Feature measurements of all relations in one long table."""
    return dynamic_measurements(_relations(spark, d))


def study_features(spark, d):
    """The 206-column feature table of all customers, from onset to a week after."""
    customer = read(spark, d, "customer")
    cohort = cut_lineage(
        customer.selectExpr(
            "c_custkey AS stay_id", "c_nationkey * 60 AS onset", f"c_nationkey * 60 + {WINDOW} AS enrollment",
            "CAST(c_custkey % 4 + 1 AS INT) AS severity",
        )
    )
    outcomes = customer.selectExpr(
        "c_custkey AS stay_id", "CAST(c_custkey % 3 AS INT) AS status", "CAST(c_custkey % 5 - 1 AS INT) AS detail",
        "c_nationkey AS unit", "c_nationkey + 1 AS hospital",
    ).filter("stay_id % 7 <> 0")
    return feature_table(_relations(spark, d), cohort, outcomes)


# --- fitted folds -----------------------------------------------------------

FEATURES = ["price", "balance", "nation"]
RISK = "o_totalprice / 1000 + c_acctbal / 50 + o_orderkey * 37 % 101 > 330"
GAPPY = {
    "price": "CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_totalprice END",
    "balance": "CASE WHEN o_orderkey % 11 = 2 THEN NULL ELSE c_acctbal END",
    "nation": "CAST(c_nationkey AS DOUBLE)",
}


def _held_out(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS key", f"CAST(o_orderkey % {FOLDS} AS INT) AS fold", f"CAST({RISK} AS INT) AS label",
        *[f"{rule} AS {name}" for name, rule in GAPPY.items()],
    )
    # read by five fits and their scores
    scored = held_out_scores(cut_lineage(rows), "fold", FOLDS, FEATURES, models.gaussian_bayes(), ["key", "fold", "label"])
    return rounded(scored, 6, "score")


def trained_folds(spark, d):
    """Impute, scale and fit on the other folds: area, largest gap and accuracy of each fold left out."""
    scored = cut_lineage(_held_out(spark, d))
    metrics = evaluation.auc_and_ks(scored, ["fold"])
    hits = scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")
    )
    return rounded(metrics.join(hits, "fold"), 6, "auc", "ks", "accuracy")


def trained_mean_roc(spark, d):
    """Mean ROC curve with its band over the fitted folds."""
    points = evaluation.roc_points(cut_lineage(_held_out(spark, d)), ["fold"])
    return rounded(evaluation.mean_roc(points), 6, "fpr", "tpr", "lower", "upper")


QUERIES = {f.__name__: f for f in (combined_extraction, study_features, trained_folds, trained_mean_roc)}

# --- SQL ---------------------------------------------------------------------

_NURSING = CHART_TEXT.format(string="VARCHAR")
_ROWS = f"""{sql_events()},
timed AS (SELECT user_id AS stay_id, m0.offset_min, m0.name, m0.value FROM (
    SELECT stay_id AS user_id, offset_min, {EVENT_NAMES.replace('event_type', 'name')} AS name, value FROM m WHERE value > 0) m0
  UNION ALL SELECT o_custkey, o_orderkey % 5760, 'PIP (cmH2O)', CAST(floor(o_totalprice / 9000) AS DOUBLE) FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_custkey, o_orderkey % 5760, {CHARTED}, try_cast({_NURSING} AS DOUBLE) FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND regexp_matches({_NURSING}, '[0-9]')
  UNION ALL SELECT c_custkey, c_nationkey * 100, 'EtCO2', CAST(floor(c_acctbal / 100) AS DOUBLE) FROM customer
  UNION ALL SELECT l_suppkey, l_partkey % 5000, 'padiastolic', l_quantity FROM lineitem WHERE l_quantity > 0
  UNION ALL SELECT l_suppkey, l_partkey % 5000, 'pasystolic', l_quantity + 40 FROM lineitem WHERE l_quantity + 40 > 0
  UNION ALL SELECT l_suppkey, l_partkey % 5000, 'pamean', l_tax * 100 FROM lineitem WHERE l_tax * 100 > 0),
once AS (SELECT c_custkey AS stay_id, 0 AS offset_min, 'hematocrit' AS name, c_acctbal AS value FROM customer WHERE c_acctbal > 0)"""

_SYNONYM = "CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.SYNONYMS.items()) + " ELSE name END"


def _sql_like(column: str, patterns, but=()) -> str:
    hit = " OR ".join(f"{column} LIKE '{p}'" for p in patterns)
    return f"({hit})" + "".join(f" AND NOT {column} LIKE '{p}'" for p in but)


def _sql_flag(flag: str) -> str:
    tests = [
        f"kind = '{kind}' AND {_sql_like(column, table[flag])}"
        for kind, column, table in (
            ("admission", "drug", rules.ADMISSION_DRUGS), ("given", "drug", rules.MEDICATION_DRUGS),
            ("given", "lower(drug)", rules.MEDICATION_DRUGS_ANY_CASE), ("treated", "drug", rules.TREATMENT_FLAGS),
        )
        if flag in table
    ]
    return f'max(CASE WHEN {" OR ".join(f"({t})" for t in tests)} THEN 1 ELSE 0 END) AS "{flag}"' if tests else f'0 AS "{flag}"'


_FLAGS = f"""drugs AS (SELECT c_custkey AS stay_id, 'admission' AS kind, {ADMISSION_DRUG} AS drug, (c_custkey * 37) % 20000 AS begun, 0 AS stop FROM customer
  UNION ALL SELECT o_custkey, 'given', {GIVEN_DRUG}, o_orderkey % 9000, CAST(o_orderkey % 9000 + floor(o_totalprice / 100) AS BIGINT) FROM orders
  UNION ALL SELECT o_custkey, 'treated', {TREATMENT}, o_orderkey % 20000, 0 FROM orders),
flags AS (SELECT stay_id, {', '.join(map(_sql_flag, rules.DRUG_FLAGS))} FROM drugs JOIN w USING (stay_id)
  WHERE begun >= onset AND begun < enrollment AND (kind <> 'given' OR stop < enrollment) GROUP BY 1)"""

_DISEASES = ", ".join(
    f"CASE WHEN {_sql_like('dx', patterns, rules.DISEASE_EXCEPTIONS.get(flag, ()))} THEN 1 ELSE 0 END AS \"{flag}\"" for flag, patterns in rules.DISEASES.items()
)
_METRES = f"CASE WHEN {HEIGHT} > 100 THEN {HEIGHT} / 100 WHEN {HEIGHT} > 1 THEN {HEIGHT} END"

_STUDY = f"""WITH {_ROWS},
w AS (SELECT c_custkey AS stay_id, c_nationkey * 60 AS onset, c_nationkey * 60 + {WINDOW} AS enrollment FROM customer),
inside AS (SELECT t.* FROM timed t JOIN w USING (stay_id) WHERE offset_min >= onset AND offset_min < enrollment
  UNION ALL SELECT * FROM once),
{sql_pairs('inside', 'w_', rules.PAO2, rules.FIO2)},
named AS (SELECT stay_id, {_SYNONYM} AS name, value FROM inside UNION ALL SELECT stay_id, '{rules.PF_RATIO}', pf FROM w_pairs),
stats AS ({_sql_stats('named')}),
wide AS (SELECT stay_id, {', '.join(f"max({s}) FILTER (name = '{n}') AS " + f'"{n}_{s}"' for n in rules.FEATURE_MEASUREMENTS for s in rules.STATISTICS)}
  FROM stats GROUP BY 1),
{_FLAGS},
person AS (SELECT c_custkey AS id, {ADMISSION} AS dx, CAST(c_nationkey % 5 AS INTEGER) AS admitsource,
  CASE WHEN c_acctbal > 9000 THEN 90.0 ELSE CAST(c_custkey % 89 AS DOUBLE) END AS age, CAST(1 - c_custkey % 2 AS INTEGER) AS gender,
  {sql_half_even(f'{WEIGHT} / pow({_METRES}, 2)', 2)} AS "BMI",
  CAST(CASE WHEN floor(c_acctbal / 100) > 0 THEN floor(c_acctbal / 100) END AS INTEGER) AS admission_score,
  CAST(c_custkey % 4 + 1 AS INTEGER) AS severity,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 3 AS INTEGER) END AS status,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 5 - 1 AS INTEGER) END AS detail,
  CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS unit, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey + 1 END AS hospital
  FROM customer)"""

_SCORED = f"""WITH x AS (SELECT o_orderkey AS key, CAST(o_orderkey % {FOLDS} AS INTEGER) AS fold, CAST({RISK} AS INTEGER) AS label,
  {', '.join(f'{rule} AS {name}' for name, rule in GAPPY.items())} FROM orders JOIN customer ON o_custkey = c_custkey),
y AS (SELECT f, x.* FROM x, (SELECT unnest(range({FOLDS})) AS f)),
mean AS (SELECT f, {', '.join(f"{sql_half_even(f'avg({c}) FILTER ({c} <> 0)', 3)} AS {c}_mean" for c in FEATURES)} FROM y WHERE fold <> f GROUP BY 1),
z AS (SELECT f, key, fold, label, {', '.join(f'coalesce({c}, {c}_mean) AS {c}' for c in FEATURES)} FROM y JOIN mean USING (f)),
span AS (SELECT f, {', '.join(f'min({c}) AS {c}_low, max({c}) AS {c}_high' for c in FEATURES)} FROM z WHERE fold <> f GROUP BY 1),
v AS ({' UNION ALL '.join(f"SELECT f, key, fold, label, '{c}' AS i, ({c} - {c}_low) / ({c}_high - {c}_low) AS v FROM z JOIN span USING (f)" for c in FEATURES)}),
eps AS (SELECT f, 1e-9 * max(s) AS e FROM (SELECT f, i, var_pop(v) AS s FROM v WHERE fold <> f GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT f, label AS c, i, avg(v) AS mu, var_pop(v) + any_value(e) AS s FROM v JOIN eps USING (f) WHERE fold <> f GROUP BY 1, 2, 3),
pr AS (SELECT f, label AS c, ln(count(*) / sum(count(*)) OVER (PARTITION BY f)) AS lp FROM y WHERE fold <> f GROUP BY 1, 2),
ll AS (SELECT f, key, c, any_value(label) AS label, sum(-0.5 * ln(2 * pi() * s) - (v - mu) * (v - mu) / (2 * s)) AS l
  FROM v JOIN st USING (f, i) WHERE fold = f GROUP BY 1, 2, 3),
odds AS (SELECT f AS fold, key, any_value(label) AS label, sum(CASE c WHEN 1 THEN l + lp ELSE -(l + lp) END) AS o FROM ll JOIN pr USING (f, c) GROUP BY 1, 2),
s AS (SELECT CAST(fold AS INTEGER) AS fold, key, label, CAST(o > 0 AS INTEGER) AS prediction, round(1 / (1 + exp(-o)), 6) AS score FROM odds)"""

_AREA6 = _AREA.replace(", 9)", ", 6)")

SQL = {
    "combined_extraction": f"""WITH {_ROWS}
SELECT stay_id, CAST(offset_min AS INTEGER) AS offset_min, name, value, FALSE AS any_time FROM timed
UNION ALL SELECT stay_id, CAST(offset_min AS INTEGER), name, value, TRUE FROM once""",
    "study_features": f"""{_STUDY}
SELECT id, {', '.join(f'CAST(coalesce("{c}", 0) AS INTEGER) AS "{c}"' for c in rules.DRUG_FLAGS)}, {_DISEASES}, admitsource, age, gender, "BMI", admission_score,
  {', '.join(f'"{c}"' for c in rules.measurement_header())}, status, detail, severity, unit, hospital
FROM person LEFT JOIN flags ON flags.stay_id = id LEFT JOIN wide ON wide.stay_id = id""",
    "trained_folds": f"""{_SCORED},
{_sql_curve('fold')},
a AS (SELECT fold, {_AREA6} FROM r GROUP BY 1),
h AS (SELECT fold, count(*) AS n, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s GROUP BY 1)
SELECT fold, auc, ks, n, accuracy FROM a JOIN h USING (fold)""",
    "trained_mean_roc": f"""{_MEAN.replace(_S, _SCORED)}
SELECT CAST(g AS INTEGER) AS g, round(x, 6) AS fpr, round(m, 6) AS tpr, round(greatest(m - sd, 0), 6) AS lower,
  round(least(m + sd, 1), 6) AS upper FROM band""",
}
