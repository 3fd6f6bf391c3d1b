"""Pairing, onset, window and feature queries on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from breathline.catalog.binding import (
    INSPIRED,
    MIDPOINT,
    OXYGEN,
    PRESSURE,
    events_long,
    rounded,
    sql_events,
    sql_half_even,
    sql_onset,
    sql_pairs,
)
from breathline.functions.clinical import severity_band
from breathline.operators import joins, ordering, reshape, series, summaries
from breathline.operators.distribution import feature_statistics
from breathline.plans.cohort import admission_or_course_onset
from breathline.plans.features import LONG_COLUMNS
from breathline.session import cut_lineage

# On these tables nearly every series passes 300 at once; the lower ratio and
# longer hold make both outcomes occur.
THRESHOLD, SUSTAIN = 60, 1440
SYNONYMS = {"click": "contact", "signup": "contact"}
NAMES = ["contact", "error", "purchase", "view", "ratio"]
STATS = ["median", "variances", "changerate"]


def _pairs(spark, d, origin="2024-01-01", **options):
    return series.pair_series(events_long(spark, d, origin), OXYGEN, INSPIRED, **options)


def pf_pairs_locf(spark, d):
    out = _pairs(spark, d).select("stay_id", "offset_min", "pao2", "fio2", "pf")
    return rounded(out, 6, "fio2", "pf")


def pf_pairs_nonpositive_fill(spark, d):
    rows = events_long(spark, d).withColumn("value", F.when(F.col("value") > 5, F.col("value")).otherwise(0.0))
    out = series.pair_series(rows, OXYGEN, INSPIRED, fill="nonpositive")
    # the ratio of the rounded parts: summation order may move a mean by one unit in the last place
    out = rounded(out.select("stay_id", "offset_min", "pao2", "fio2"), 10, "pao2", "fio2")
    return out.withColumn("pf", F.round(F.try_divide("pao2", "fio2"), 6))


def pf_onset(spark, d):
    return rounded(series.sustained_onset(_pairs(spark, d), THRESHOLD, SUSTAIN), 6, "min_pf")


def pf_severity_by_day(spark, d):
    days = _pairs(spark, d).groupBy("stay_id", F.floor(F.col("offset_min") / 1440).alias("day"))
    return days.agg(F.min("pf").alias("p")).select(
        "stay_id", "day", F.round("p", 6).alias("min_pf"), severity_band(F.col("p")).alias("severity")
    )


def pf_sustained_anchor(spark, d):
    return series.sustained_since_failure(_pairs(spark, d), 45, 4320).select(
        "stay_id", F.col("sustained").cast("int").alias("sustained")
    )


def _admission(spark, d):
    """Earliest value of both analytes per stay, as if taken at admission."""
    first = events_long(spark, d, MIDPOINT).groupBy("stay_id")

    def earliest(name):
        # equal minutes: the larger value counts
        at = F.when(F.col("name") == name, F.struct("offset_min", (-F.col("value")).alias("v")))
        return -F.min(at)["v"]

    return first.agg(earliest(OXYGEN).alias("pao2"), earliest(INSPIRED).alias("fio2"))


def pf_admission_or_course(spark, d):
    rows = events_long(spark, d, MIDPOINT).filter(F.col("name").isin(OXYGEN, INSPIRED))
    rows = rows.withColumn(
        "name", F.when(F.col("name") == OXYGEN, series.PAO2).otherwise(series.FIO2)
    )
    return admission_or_course_onset(_admission(spark, d), rows, THRESHOLD, SUSTAIN)


def peep_violation_anti(spark, d):
    onsets = series.sustained_onset(_pairs(spark, d), THRESHOLD, SUSTAIN)
    onsets = onsets.filter(F.col("onset").isNotNull()).select("stay_id", "onset", "severity")
    return joins.reject_low_peep(events_long(spark, d), onsets, minimum=20, lookback=2880, peep=PRESSURE)


def grid_completion(spark, d):
    rows = series.complete_grid(events_long(spark, d), OXYGEN, INSPIRED)
    return rows.select("stay_id", "offset_min", "pao2", "fio2")


def conditional_means(spark, d):
    out = summaries.conditional_means(events_long(spark, d), [OXYGEN, INSPIRED])
    return out.select(
        "stay_id", F.round(f"mean_{OXYGEN}", 6).alias("mean_a"), F.round(f"mean_{INSPIRED}", 6).alias("mean_b")
    )


def _windows(spark, d):
    """Three-day windows from the onset."""
    onsets = series.sustained_onset(_pairs(spark, d), THRESHOLD, SUSTAIN)
    return onsets.filter(F.col("onset").isNotNull()).select(
        "stay_id", "onset", (F.col("onset") + 4320).alias("enrollment")
    )


def interval_join_rows(spark, d):
    inside = joins.interval_join(events_long(spark, d), _windows(spark, d), "onset", "enrollment")
    return inside.select(*LONG_COLUMNS, "onset")


def open_interval_counts(spark, d):
    later = joins.interval_join(events_long(spark, d), _windows(spark, d), "enrollment", None)
    return later.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"), F.max("offset_min").alias("last_minute"))


def _stats(spark, d):
    inside = joins.interval_join(events_long(spark, d), _windows(spark, d), "onset", "enrollment")
    # few rows, read twice below: once for the ratio, once for the statistics
    inside = cut_lineage(inside.select(*LONG_COLUMNS))
    pairs = series.pair_series(inside, OXYGEN, INSPIRED, fill="nonpositive")
    ratio = pairs.select("stay_id", "offset_min", F.lit("ratio").alias("name"), F.col("pf").alias("value"))
    return feature_statistics(joins.rename_synonyms(inside.unionByName(ratio), SYNONYMS))


def interval_join_stats(spark, d):
    return _stats(spark, d)


def feature_wide(spark, d):
    wide = reshape.pivot_statistics(_stats(spark, d), "stay_id", NAMES)
    header = ["stay_id", *[f"{n}_{s}" for n in NAMES for s in STATS]]
    return reshape.select_header(wide, header)


def whole_course_statistics(spark, d):
    return feature_statistics(events_long(spark, d))


def synonym_rename(spark, d):
    long = events_long(spark, d)
    exact = joins.rename_synonyms(long, SYNONYMS).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    part = joins.rename_by_substring(long, {"ew": "seen", "e": "other"})
    part = part.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return exact.withColumn("rule", F.lit("exact")).unionByName(part.withColumn("rule", F.lit("part")))


def time_spine(spark, d):
    return joins.time_spine(events_long(spark, d), [OXYGEN, INSPIRED]).select(*LONG_COLUMNS)


def first_measurement(spark, d):
    return ordering.first_per_key(
        events_long(spark, d), ["stay_id"], [F.col("offset_min"), F.col("name"), F.col("value")],
        ["offset_min", "name", "value"],
    )


def series_in_order(spark, d):
    return ordering.sorted_series(events_long(spark, d), "stay_id", "offset_min", "name", "value")


def event_slices(spark, d):
    """Consecutive slices of seven ids, as size and id range of each slice."""
    ids = events_long(spark, d).select("stay_id").distinct()
    slices = ordering.equal_slices(ids, "stay_id", 7)
    return slices.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("stay_id").alias("low"), F.max("stay_id").alias("high")
    )


QUERIES = {
    f.__name__: f
    for f in (
        pf_pairs_locf, pf_pairs_nonpositive_fill, pf_onset, pf_severity_by_day, pf_sustained_anchor,
        pf_admission_or_course, peep_violation_anti, grid_completion, conditional_means,
        interval_join_rows, open_interval_counts, interval_join_stats, feature_wide,
        whole_course_statistics, synonym_rename, time_spine, first_measurement, series_in_order,
        event_slices,
    )
}

_M = "WITH " + sql_events()
_PAIRS = f"{_M},\n{sql_pairs()}"
_ONSET = f"{_PAIRS},\n{sql_onset(THRESHOLD, SUSTAIN)}"
_WINDOWS = f"""{_ONSET},
windows AS (SELECT stay_id, onset, onset + 4320 AS enrollment FROM onset WHERE onset IS NOT NULL),
inside AS (SELECT m.*, onset FROM m JOIN windows USING (stay_id)
  WHERE offset_min >= onset AND offset_min < enrollment)"""


def _sql_stats(source: str) -> str:
    return f"""SELECT stay_id, name, {sql_half_even('median(value)', 2)} AS median,
  {sql_half_even('var_pop(value)', 2)} AS variances,
  {sql_half_even('(max(value) - min(value)) / min(value)', 2)} AS changerate
  FROM {source} WHERE value > 1e-6 GROUP BY 1, 2"""


_STATS = f"""{_WINDOWS},
{sql_pairs('inside', 'w_')},
named AS (SELECT stay_id, CASE WHEN name IN ('click', 'signup') THEN 'contact' ELSE name END AS name, value FROM inside
  UNION ALL SELECT stay_id, 'ratio', pf FROM w_pairs),
stats AS ({_sql_stats('named')})"""

_SQL_GRID = f"""{_M},
g AS (SELECT stay_id, offset_min, max(value) FILTER (name = '{OXYGEN}') AS a,
  max(value) FILTER (name = '{INSPIRED}') AS b FROM m WHERE name IN ('{OXYGEN}', '{INSPIRED}') GROUP BY 1, 2),
mean AS (SELECT stay_id, {sql_half_even('avg(a)', 1)} AS ma, {sql_half_even('avg(b)', 1)} AS mb,
  count(a) + count(b) AS n FROM g GROUP BY 1)
SELECT stay_id, offset_min, coalesce(nullif(a, 0), ma) AS pao2, coalesce(nullif(b, 0), mb) AS fio2
FROM g JOIN mean USING (stay_id) WHERE n > 1 AND ma <> 0 AND mb <> 0"""

_MID = f"WITH {sql_events(MIDPOINT)}"
_SQL_ADMISSION = f"""{_MID},
first AS (SELECT stay_id,
  (SELECT value FROM m x WHERE x.stay_id = s.stay_id AND name = '{OXYGEN}'
   ORDER BY offset_min, value DESC LIMIT 1) AS p,
  (SELECT value FROM m x WHERE x.stay_id = s.stay_id AND name = '{INSPIRED}'
   ORDER BY offset_min, value DESC LIMIT 1) AS f
  FROM (SELECT DISTINCT stay_id FROM m) s),
adm AS (SELECT stay_id, p / CASE WHEN f > 1 THEN f / 100 ELSE f END AS apf FROM first WHERE p > 0 AND f > 0),
hit AS (SELECT * FROM adm WHERE apf <= {THRESHOLD}),
before AS (SELECT * FROM m WHERE offset_min >= -480 AND offset_min < 0),
{sql_pairs('before', 'b_')},
sev AS (SELECT stay_id, CASE WHEN min(pf) <= 100 THEN 1 WHEN min(pf) <= 200 THEN 2
  WHEN min(pf) <= 300 THEN 3 END AS s FROM b_pairs GROUP BY 1),
{sql_pairs('m')},
{sql_onset(THRESHOLD, SUSTAIN)}
SELECT stay_id, CAST(0 AS BIGINT) AS onset, CAST(coalesce(s, CASE WHEN apf <= 100 THEN 1 WHEN apf <= 200 THEN 2
  WHEN apf <= 300 THEN 3 ELSE 4 END) AS INTEGER) AS severity, 1 AS at_admission
FROM hit LEFT JOIN sev USING (stay_id)
UNION ALL
SELECT stay_id, onset, severity, 0 FROM onset WHERE onset IS NOT NULL AND stay_id NOT IN (SELECT stay_id FROM hit)"""

SQL = {
    "pf_pairs_locf": f"""{_PAIRS}
SELECT stay_id, offset_min, pao2, round(fio2, 6) AS fio2, round(pf, 6) AS pf FROM pairs""",
    "pf_pairs_nonpositive_fill": f"""{_M},
z AS (SELECT stay_id, offset_min, name, CASE WHEN value > 5 THEN value ELSE 0 END AS value FROM m),
mean_of AS (SELECT stay_id, name, avg(v) AS mv FROM (SELECT stay_id, offset_min, name, max(value) AS v
  FROM z WHERE value > 1e-6 GROUP BY 1, 2, 3) GROUP BY 1, 2),
q AS (SELECT z.stay_id, offset_min, name, max(CASE WHEN value < 1e-6 THEN NULL ELSE value END) AS top,
  any_value(mv) AS mv FROM z LEFT JOIN mean_of USING (stay_id, name) GROUP BY 1, 2, 3),
f AS (SELECT stay_id, offset_min, name, coalesce(top, mv) AS value FROM q),
{sql_pairs('f')}
SELECT stay_id, offset_min, round(pao2, 10) AS pao2, round(fio2, 10) AS fio2,
  round(round(pao2, 10) / round(fio2, 10), 6) AS pf FROM pairs""",
    "pf_onset": f"""{_ONSET}
SELECT stay_id, onset, round(min_pf, 6) AS min_pf, severity, n_pairs FROM onset""",
    "pf_severity_by_day": f"""{_PAIRS}
SELECT stay_id, CAST(offset_min // 1440 AS BIGINT) AS day, round(min(pf), 6) AS min_pf,
  CAST(CASE WHEN min(pf) <= 100 THEN 1 WHEN min(pf) <= 200 THEN 2 WHEN min(pf) <= 300 THEN 3 ELSE 4 END
       AS INTEGER) AS severity
FROM pairs GROUP BY 1, 2""",
    "pf_sustained_anchor": f"""{_PAIRS},
a AS (SELECT *, round(pf, 1) < 45 AS ok, min(offset_min) OVER (PARTITION BY stay_id) AS first_min FROM pairs),
b AS (SELECT *, max(CASE WHEN NOT ok THEN offset_min END)
  OVER (PARTITION BY stay_id ORDER BY offset_min) AS anchor FROM a)
SELECT stay_id, CAST(max(CASE WHEN ok AND offset_min - coalesce(anchor, first_min) >= 4320 THEN 1 ELSE 0 END)
  AS INTEGER) AS sustained FROM b GROUP BY 1""",
    "pf_admission_or_course": _SQL_ADMISSION,
    "peep_violation_anti": f"""{_ONSET}
SELECT stay_id, onset, severity FROM onset o WHERE onset IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM m WHERE m.stay_id = o.stay_id AND name = '{PRESSURE}' AND value < 20
    AND offset_min > onset - 2880 AND offset_min <= onset)""",
    "grid_completion": _SQL_GRID,
    "conditional_means": f"""{_M}
SELECT stay_id, round(avg(value) FILTER (name = '{OXYGEN}' AND value > 1e-6), 6) AS mean_a,
  round(avg(value) FILTER (name = '{INSPIRED}' AND value > 1e-6), 6) AS mean_b
FROM m WHERE name IN ('{OXYGEN}', '{INSPIRED}') GROUP BY 1""",
    "interval_join_rows": f"{_WINDOWS}\nSELECT * FROM inside",
    "open_interval_counts": f"""{_WINDOWS}
SELECT stay_id, count(*) AS n, max(offset_min) AS last_minute FROM m JOIN windows USING (stay_id)
WHERE offset_min >= enrollment GROUP BY 1""",
    "interval_join_stats": f"{_STATS}\nSELECT * FROM stats",
    "feature_wide": f"""{_STATS}
SELECT stay_id, """ + ", ".join(
        f"max({s}) FILTER (name = '{n}') AS {n}_{s}" for n in NAMES for s in STATS
    ) + " FROM stats GROUP BY 1",
    "whole_course_statistics": f"{_M}\n{_sql_stats('m')}",
    "synonym_rename": f"""{_M}
SELECT CASE WHEN name IN ('click', 'signup') THEN 'contact' ELSE name END AS name, count(*) AS n, 'exact' AS rule
FROM m GROUP BY 1 UNION ALL
SELECT CASE WHEN name LIKE '%ew%' THEN 'seen' WHEN name LIKE '%e%' THEN 'other' ELSE name END, count(*), 'part'
FROM m GROUP BY 1""",
    "time_spine": f"""{_M}
SELECT s.stay_id, s.offset_min, v.name, v.value
FROM (SELECT DISTINCT stay_id, offset_min FROM m) s LEFT JOIN (
  SELECT stay_id, offset_min, name, max(value) AS value FROM m
  WHERE name IN ('{OXYGEN}', '{INSPIRED}') AND value IS NOT NULL GROUP BY 1, 2, 3) v USING (stay_id, offset_min)""",
    "first_measurement": f"""{_M}
SELECT stay_id, offset_min, name, value FROM (SELECT *, row_number() OVER (
  PARTITION BY stay_id ORDER BY offset_min, name, value) AS rn FROM m) WHERE rn = 1""",
    "series_in_order": f"{_M}\nSELECT stay_id, offset_min, name, value FROM m ORDER BY 1, 2, 3, 4",
    "event_slices": f"""{_M}
SELECT CAST((rn - 1) // 7 AS BIGINT) AS slice, count(*) AS n, min(stay_id) AS low, max(stay_id) AS high FROM (
  SELECT stay_id, row_number() OVER (ORDER BY stay_id) AS rn FROM (SELECT DISTINCT stay_id FROM m)) GROUP BY 1""",
}
