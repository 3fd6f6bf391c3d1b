"""Cohort selection, outcome and mortality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from breathline.catalog.binding import (
    INSPIRED,
    MIDPOINT,
    OXYGEN,
    PRESSURE,
    events_long,
    read,
    rounded,
    sql_onset,
    sql_pairs,
)
from breathline.catalog.relational import AGE_TEXT
from breathline.catalog.timeseries import _SQL_ADMISSION, SUSTAIN, THRESHOLD, _admission
from breathline.functions.clinical import is_adult
from breathline.functions.rules import FIO2, PAO2, PEEP
from breathline.operators import joins, summaries
from breathline.plans.cohort import cohort_funnel, oxygenation_measurements, peep_supported_ids, ventilated_ids
from breathline.plans.outcomes import label_outcomes

PEEP_LIMIT = 15
ROLES = {OXYGEN: PAO2, INSPIRED: FIO2, PRESSURE: PEEP}


def _series(spark, d):
    rows = events_long(spark, d, MIDPOINT).filter(F.col("name").isin(*ROLES))
    return joins.rename_synonyms(rows, ROLES)


def _charting(spark, d):
    """Events as respiratory charting: text values under the labels of the rules."""
    label = (
        F.when(F.col("event_type") == "error", "RT Vent On/Off")
        .when(F.col("event_type") == INSPIRED, FIO2)
        .otherwise("LPM O2")
    )
    value = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 100), "Start")
        .when((F.col("event_type") == "error") & (F.col("value") > 60), "Continued")
        .when((F.col("event_type") == "error"), "Off")
        .when(F.col("event_type") == INSPIRED, F.floor(F.col("value") / 4).cast("string"))
        .otherwise((F.floor(F.col("value") * 3) + 2).cast("string"))
    )
    rows = read(spark, d, "events").filter(F.col("event_type").isin("error", INSPIRED, "click"))
    return rows.select(
        F.col("user_id").alias("patientunitstayid"), label.alias("respchartvaluelabel"), value.alias("respchartvalue")
    )


def vent_set_ops(spark, d):
    return ventilated_ids(_charting(spark, d))


def _funnel(spark, d):
    adults = (
        read(spark, d, "customer").withColumn("age", F.expr(AGE_TEXT.format(string="STRING")))
        .filter(is_adult(F.col("age"))).select(F.col("c_custkey").alias("stay_id"))
    )
    buyers = read(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("stay_id"))
    return cohort_funnel(
        adults, [ventilated_ids(_charting(spark, d)), buyers], _admission(spark, d), _series(spark, d),
        THRESHOLD, SUSTAIN, PEEP_LIMIT,
    )


def cohort_funnel_counts(spark, d):
    return _funnel(spark, d).counts()


def cohort_rows(spark, d):
    return _funnel(spark, d).cohort


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Expired' WHEN 'P' THEN NULL ELSE 'Alive' END"
HOSPITAL = "CASE WHEN o_orderpriority < '3' THEN 'Expired' ELSE 'Alive' END"


def _discharges(spark, d):
    """One row per stay from the customer's first order."""
    first = read(spark, d, "orders").groupBy("o_custkey").agg(
        F.min_by(F.struct("o_orderstatus", "o_orderpriority", "o_totalprice"), "o_orderkey").alias("o")
    ).select(F.col("o_custkey").alias("stay_id"), "o.*")
    minutes = F.floor(F.col("o_totalprice") / 8)
    return first.select(
        "stay_id", F.expr(STATUS).alias("unit_status"), F.expr(HOSPITAL).alias("hospital_status"),
        F.when(F.col("stay_id") % 3 == 0, "Home").alias("unit_location"),
        F.when(F.col("stay_id") % 2 == 0, "Home").alias("hospital_location"),
        minutes.alias("unit_discharge"), (minutes + 4000).alias("hospital_discharge"),
        (-F.col("stay_id")).alias("hospital_admit"),
    )


def outcome_labels(spark, d):
    rows = _series(spark, d)
    onsets = joins.clipped(rows, "offset_min", None, 0).groupBy("stay_id").agg(
        (F.max("offset_min") + 1440).alias("enrollment")
    )
    return label_outcomes(onsets, _discharges(spark, d), rows, threshold=40, sustain=2880)


SEVERITY = "CASE WHEN o_orderpriority < '2' THEN 1 WHEN o_orderpriority < '3' THEN 2 WHEN o_orderpriority < '4' THEN 3 ELSE 4 END"
DETAIL = (
    "CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN -1 "
    "WHEN o_totalprice > 350000 THEN 1 WHEN o_totalprice > 150000 THEN 2 ELSE 3 END"
)
SHARES = [f"{p}_{kind}_share" for p in ("icu", "day28", "hospital") for kind in ("cohort", "death")]


def _deaths(spark, d):
    return read(spark, d, "orders").select(F.expr(SEVERITY).alias("severity"), F.expr(DETAIL).alias("detail"))


def mortality_by_band(spark, d):
    return rounded(summaries.mortality_by_band(_deaths(spark, d)), 9, *SHARES)


def mortality_total(spark, d):
    return rounded(summaries.mortality_total(_deaths(spark, d)), 9, "icu_rate", "day28_rate", "hospital_rate")


def _as_lab(spark, d):
    rows = events_long(spark, d)
    name = F.when(F.col("name") == OXYGEN, PAO2).when(F.col("name") == INSPIRED, FIO2).otherwise("arterial PEEP")
    return rows.select(
        F.col("stay_id").alias("patientunitstayid"), name.alias("labname"), F.col("value").alias("labresult"),
        F.col("offset_min").alias("labresultoffset"),
    )


def _as_charting(spark, d):
    return read(spark, d, "orders").select(
        F.col("o_custkey").alias("patientunitstayid"),
        F.when(F.col("o_orderstatus") == "F", FIO2).otherwise("Set PEEP").alias("respchartvaluelabel"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("40%"))
        .otherwise(F.floor(F.col("o_totalprice") / 25000).cast("string")).alias("respchartvalue"),
        (F.col("o_orderkey") - 500).alias("respchartoffset"),
    )


def _as_exam(spark, d):
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("patientunitstayid"),
        F.when(F.col("c_mktsegment") == "BUILDING", "FiO2%").when(F.col("c_mktsegment") == "MACHINERY", "PEEP level")
        .otherwise("CVP").alias("physicalexamvalue"),
        F.when(F.col("c_acctbal") < 0, F.lit("n/a")).otherwise(F.floor(F.col("c_acctbal") / 900).cast("string"))
        .alias("physicalexamtext"),
        F.col("c_nationkey").alias("physicalexamoffset"),
    )


def oxygenation_union(spark, d):
    rows = oxygenation_measurements(_as_lab(spark, d), _as_charting(spark, d), _as_exam(spark, d))
    return rows.withColumn("offset_min", F.col("offset_min").cast("bigint"))


def peep_supported(spark, d):
    return peep_supported_ids(_as_lab(spark, d), _as_charting(spark, d), _as_exam(spark, d), 5.0)


QUERIES = {
    f.__name__: f
    for f in (
        vent_set_ops, cohort_funnel_counts, cohort_rows, outcome_labels, mortality_by_band, mortality_total,
        oxygenation_union, peep_supported,
    )
}

_VENT = f"""charting AS (SELECT user_id AS stay_id, event_type AS e, value AS v FROM events
  WHERE event_type IN ('error', '{INSPIRED}', 'click')),
vent AS ((SELECT stay_id FROM charting WHERE e = 'error' AND v > 60
  UNION SELECT stay_id FROM charting WHERE e = '{INSPIRED}' AND floor(v / 4) > 21)
  EXCEPT SELECT stay_id FROM charting WHERE e = 'click' AND floor(v * 3) + 2 <= 3)"""

_HEAD, _BODY = _SQL_ADMISSION.split("SELECT stay_id, CAST(0 AS BIGINT) AS onset")
_RULE = f"{_HEAD.rstrip()},\nrule AS (SELECT stay_id, CAST(0 AS BIGINT) AS onset{_BODY}"
# the admission-or-course rule, restricted to eligible stays, then the PEEP check
_FUNNEL = f"""{_RULE}),
{_VENT},
t AS (SELECT c_custkey AS stay_id, {AGE_TEXT.format(string='VARCHAR')} AS age FROM customer),
adults AS (SELECT stay_id FROM t WHERE age = '> 89' OR (regexp_matches(age, '[0-9]') AND try_cast(age AS DOUBLE) >= 18)),
eligible AS (SELECT stay_id FROM adults INTERSECT SELECT stay_id FROM vent
  INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 250000),
onsets AS (SELECT * FROM rule WHERE stay_id IN (SELECT stay_id FROM eligible)),
cohort AS (SELECT *, onset + 1440 AS enrollment FROM onsets o WHERE NOT EXISTS (SELECT 1 FROM m
  WHERE m.stay_id = o.stay_id AND name = '{PRESSURE}' AND value < {PEEP_LIMIT}
    AND offset_min > onset - {SUSTAIN} AND offset_min <= onset))"""

_DEATHS = f"WITH x AS (SELECT {SEVERITY} AS severity, {DETAIL} AS detail FROM orders)"
_CUM = [("icu", 0), ("day28", 1), ("hospital", 2)]

SQL = {
    "vent_set_ops": f"WITH {_VENT} SELECT stay_id FROM vent",
    "cohort_funnel_counts": f"""{_FUNNEL}
SELECT 1 AS step, 'adult' AS stage, count(*) AS stays FROM adults UNION ALL
SELECT 2, 'eligible', count(*) FROM eligible UNION ALL
SELECT 3, 'onset', count(*) FROM onsets UNION ALL SELECT 4, 'cohort', count(*) FROM cohort""",
    "cohort_rows": f"{_FUNNEL}\nSELECT * FROM cohort",
    "outcome_labels": _SQL_ADMISSION.split(",\nfirst AS")[0]
    + f""",
c AS (SELECT stay_id, max(offset_min) + 1440 AS enrollment FROM m
  WHERE name IN ('{OXYGEN}', '{INSPIRED}', '{PRESSURE}') AND offset_min < 0 GROUP BY 1),
later AS (SELECT m.* FROM m JOIN c USING (stay_id) WHERE offset_min >= enrollment + 1440),
{sql_pairs('later')},
{sql_onset(40, 2880)},
f AS (SELECT o_custkey AS stay_id, o_orderstatus, o_orderpriority, CAST(floor(o_totalprice / 8) AS BIGINT) AS um
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
x AS (SELECT stay_id, enrollment + 1440 AS lim, {STATUS} AS us, {HOSPITAL} AS hs, um, um + 4000 AS hm,
  CASE WHEN stay_id % 3 = 0 THEN 'Home' END AS ul, CASE WHEN stay_id % 2 = 0 THEN 'Home' END AS hl,
  um // 1440 AS unit, (um + 4000 + stay_id) // 1440 AS hospital,
  stay_id IN (SELECT stay_id FROM onset WHERE onset IS NOT NULL) AS hyp FROM c JOIN f USING (stay_id))
SELECT stay_id, CAST(CASE WHEN hyp THEN 1
  WHEN us = 'Expired' AND um <= lim THEN 2 WHEN hs = 'Expired' AND hm <= lim THEN 2
  WHEN us IS DISTINCT FROM 'Expired' AND um <= lim THEN 0
  WHEN hs IS DISTINCT FROM 'Expired' AND hm <= lim THEN 0 ELSE 1 END AS INTEGER) AS status,
  CAST(CASE WHEN us = 'Expired' AND hl IS DISTINCT FROM 'Home' THEN 0
  WHEN us = 'Expired' THEN CASE WHEN unit < 28 THEN 1 ELSE 3 END
  WHEN hs = 'Expired' THEN CASE WHEN hospital < 28 THEN 1 WHEN ul IS DISTINCT FROM 'Home' THEN 2 ELSE 3 END
  ELSE -1 END AS INTEGER) AS detail, unit, hospital FROM x""",
    "mortality_by_band": f"""{_DEATHS},
b AS (SELECT severity, count(*) AS n, count(*) FILTER (detail > -1) AS deaths,
  {', '.join(f"count(*) FILTER (detail = {c}) AS n_{p}_exact, count(*) FILTER (detail > -1 AND detail <= {c}) AS n_{p}" for p, c in _CUM)},
  CAST(grouping(severity) AS INTEGER) AS is_total FROM x GROUP BY ROLLUP (severity)),
t AS (SELECT n AS tn, deaths AS td FROM b WHERE is_total = 1)
SELECT b.*, {', '.join(f"round(n_{p} / tn, 9) AS {p}_cohort_share, round(n_{p} / td, 9) AS {p}_death_share" for p, _ in _CUM)}
FROM b, t""",
    "mortality_total": f"""{_DEATHS}
SELECT count(*) AS n, {', '.join(f"count(*) FILTER (detail > -1 AND detail <= {c}) AS {p}_deaths, round(count(*) FILTER (detail > -1 AND detail <= {c}) / count(*), 9) AS {p}_rate" for p, c in _CUM)} FROM x""",
    "oxygenation_union": f"""SELECT user_id AS stay_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 1440
  + hour(ts) * 60 + minute(ts) AS BIGINT) AS offset_min,
  CASE event_type WHEN '{OXYGEN}' THEN '{PAO2}' ELSE '{FIO2}' END AS name, value FROM events
WHERE event_type IN ('{OXYGEN}', '{INSPIRED}') AND ts >= TIMESTAMP '2024-01-01 00:01:00'
UNION SELECT o_custkey, o_orderkey - 500, '{FIO2}', CAST(floor(o_totalprice / 25000) AS DOUBLE) FROM orders
WHERE o_orderstatus = 'F' AND o_orderkey > 500 AND o_orderpriority <> '5-LOW'
UNION SELECT c_custkey, CAST(c_nationkey AS BIGINT), '{FIO2}', CAST(floor(c_acctbal / 900) AS DOUBLE) FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 0 AND c_acctbal >= 0""",
    "peep_supported": f"""SELECT user_id AS stay_id FROM events WHERE event_type NOT IN ('{OXYGEN}', '{INSPIRED}') AND value >= 5
UNION SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AND floor(o_totalprice / 25000) >= 5
UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND floor(c_acctbal / 900) >= 5""",
}
