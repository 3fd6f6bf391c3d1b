"""Clinical relations end to end, and the shape of the physical plans."""

import re

import pytest

from breathline.catalog.binding import events_long
from breathline.functions import rules
from breathline.operators.series import pair_series, sustained_onset
from breathline.plans import cohort, features, study
from breathline.sources.schemas import RELATIONS

P, Q, PEEP = rules.PAO2, rules.FIO2, rules.PEEP
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Six stays: 1 qualifies at admission, 2 during the course, the others drop out."""
    def patient(i, age, status="Alive", place="Floor"):
        return (i, age, "Female" if i % 2 else "Male", "Floor", 80.0, 1.8, "Pneumonia, viral", status, status, place,
                place, 9000, 9500, -600, "10:00")

    rows = {
        "patient": [patient(1, "> 89", "Expired"), patient(2, "40"), patient(3, "17"), patient(4, "50"),
                    patient(5, "60"), patient(6, "70")],
        "diagnosis": [(i, "518.81, J96", "pulmonary|respiratory failure", 5) for i in range(1, 7)]
        + [(4, "428", "cardiovascular|congestive heart failure", 5)],
        "admissiondx": [(1, "admission|respiratory failure", "x", 0)],
        "apacheapsvar": [(1, 60.0, 50.0, 33.0, 2.0), (2, 90.0, 21.0, None, 2.0)],
        "apachepatientresult": [(1, 77), (2, -1)],
        "lab": [(1, P, 60.0, -100), (1, Q, 80.0, -100), (1, "HCO3", 20.0, 10), (1, "bicarbonate", 24.0, 20),
                (1, P, 80.0, 30), (1, Q, 40.0, 30), (1, "glucose", 100.0, 1439), (1, "glucose", 900.0, 1440)]
        + [(i, n, v, t) for i in (2, 3, 4, 5, 6) for t in (0, 300, 600) for n, v in ((P, 60.0), (Q, 50.0))]
        + [(5, PEEP, 4.0, 500), (2, PEEP, 8.0, 500)],
        "customlab": [(1, "PIP (cmH2O)", "30", 50)],
        "nursecharting": [(1, "Heart Rate", "88", 15), (1, "Heart Rate", "n/a", 16), (2, "Heart Rate", "70", 700)],
        "respiratorycharting": [(i, i, "RT Vent On/Off", "Start", 0, 0) for i in range(1, 6)]
        + [(6, 9, "LPM O2", "2", 0, 0), (6, 10, "FiO2", "100", 0, 0), (2, 11, "EtCO2", "35", 650, 650)],
        "physicalexam": [(1, "FiO2%", "40", 5)],
        "vitalperiodic": [(1, 12, 10.0, -1.0, None, 5.0, None, None, None, None, None)],
        "admissiondrug": [(1, "HEPARIN SODIUM", 100), (1, "MILRINONE", 2000)],
        "medication": [(1, "Norepinephrine 4 mg", 5, 100), (1, "warfarin", 5, 5000)],
        "infusiondrug": [(1, "Heparin drip", 10), (1, "Dopamine", 1441)],
        "treatment": [(1, "cardiovascular|vasopressors", 60)],
    }
    return {n: spark.createDataFrame(r, RELATIONS[n]).cache() for n, r in rows.items()}


def test_clinical_cohort_and_counts(tables):
    funnel = cohort.clinical_cohort(tables)
    got = {r.stay_id: (r.onset, r.severity, r.at_admission, r.enrollment) for r in funnel.cohort.collect()}
    # stay 1: 60 / 0.8 before admission; stay 2: 480 minutes reached at 600
    assert got == {1: (0, 1, 1, 1440), 2: (600, 2, 0, 2040)}
    counts = [(r.stage, r.stays) for r in funnel.counts().orderBy("step").collect()]
    assert counts == [("adult", 5), ("eligible", 3), ("onset", 3), ("cohort", 2)]


def test_feature_table(tables):
    table = study.study_tables(tables).features
    assert table.columns == rules.feature_header()
    got = {r["id"]: r for r in table.collect()}
    one, two = got[1], got[2]
    assert (one.age, one.gender, one.BMI, one.admission_score, one.admitsource) == (90, 0, 24.69, 77, 2)
    assert (one.Heparin, one.Milrinone, one.Norepinephrine, one.warfarin, one.Vasopressor) == (1, 0, 1, 0, 1)
    assert one.Pneumonia == 1 and one.Cancer == 0
    assert (one.bicarbonate_median, one.bicarbonate_variances, one.bicarbonate_changerate) == (22.0, 4.0, 0.2)
    assert one["P/F ratio_median"] == 200.0 and one.glucose_median == 100.0
    assert (one.hematocrit_median, one["Heart Rate_median"], one.padiastolic_median, one.cvp_median) == (33.0, 88.0, 10.0, 5.0)
    assert one.pasystolic_median is None and one.lactate_median is None
    assert (one.status, one.detail, one.severity, one.unit, one.hospital) == (1, 0, 1, 6, 7)
    assert (two.admission_score, two.etCO2_median, two["Heart Rate_median"]) == (None, 35.0, 70.0)
    assert (two.status, two.detail, two.Heparin) == (1, -1, 0)


def test_respiratory_failure_without_heart_failure(tables):
    got = cohort.respiratory_failure_without_heart_failure(tables["patient"], tables["diagnosis"], tables["admissiondx"])
    assert sorted(r.patientunitstayid for r in got.collect()) == [1, 2, 3, 5, 6]


def test_timed_flags(tables):
    assert features.infusion_flags(tables["infusiondrug"]).first().asDict()["Dopamine"] == 0
    assert features.course_diagnosis_flags(tables["diagnosis"]).filter("Respiratory_Medical_Other = 1").count() == 6


def executed_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_onset_scans_once_and_prunes(spark):
    df = sustained_onset(pair_series(events_long(spark, SF), "purchase", "view"))
    plan = executed_plan(df)
    assert len(re.findall("FileScan parquet", plan)) == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "In(event_type, [purchase,view])" in plan
    # rows are combined on the map side, and no exchange of rows is by the stay alone before that
    assert plan.count("Exchange hashpartitioning(stay_id") - plan.count("ReusedExchange") <= 4
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_onset_keys_rows_by_stay_and_block(spark):
    logical = executed_plan(sustained_onset(pair_series(events_long(spark, SF), "purchase", "view")))
    windows = re.findall(r"windowspecdefinition\(([^)]*)\)", logical)
    per_row = [w for w in windows if "offset_min" in w]
    assert per_row and all("stay_id" in w and "block" in w for w in per_row)


def test_windows_and_eligible_stays_are_not_broadcast(spark):
    """Estimates from files know nothing of the days and salts of a window; the funnel computes its ids once."""
    from breathline.operators.joins import interval_join

    rows = events_long(spark, SF)
    windows = rows.select("stay_id").distinct().selectExpr("stay_id", "0L AS onset", "10000L AS enrollment")
    plan = interval_join(rows, windows, "onset", "enrollment")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    ids = rows.select("stay_id").distinct()
    admission = ids.selectExpr("stay_id", "CAST(80 AS DOUBLE) AS pao2", "CAST(0.5 AS DOUBLE) AS fio2")
    funnel = cohort.cohort_funnel(ids, [ids], admission, rows)
    plan = funnel.checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0
