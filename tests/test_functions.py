import pytest
from pyspark.sql import functions as F

from breathline.functions import clinical, numeric, rules, text
from breathline.operators.reshape import check_header, check_schema, flag_pivot


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_text_numbers_compare_as_numbers(spark):
    values = ["100", "21", "> 89", "abc", None, " 22.5 "]
    assert column(spark, values, "string", lambda c: text.number_above(c, 21)) == [True, False, None, None, None, True]


def test_age_rule(spark):
    values = ["> 89", "17", "18", "2", "", None, "unknown"]
    assert column(spark, values, "string", clinical.age_years) == [90, 17, 18, 2, 91, 91, 91]
    assert column(spark, values, "string", clinical.is_adult) == [True, False, True, False, False, False, False]


def test_like_rules(spark):
    values = ["heart valve", "CABG with valve", None, "Sepsis, other"]
    got = column(spark, values, "string", lambda c: text.like_but_not(c, ["%valve%"], ["%CABG%"]))
    assert got == [True, False, False, False]
    assert column(spark, values, "string", lambda c: text.contains_ci(c, "cabg")) == [False, True, None, False]


def test_half_even_and_days(spark):
    assert column(spark, [2.125, 2.135, 2.5, 12.345, 0.005], "double", lambda c: numeric.half_even(c, 2)) == [
        2.12, 2.14, 2.5, 12.34, 0.0,
    ]
    assert column(spark, [1439, 1440, -1, -1440, -1441, 2881], "int", numeric.whole_days) == [0, 1, 0, -1, -1, 2]


def test_body_mass_index(spark):
    rows = [(80.0, 1.8), (80.0, 180.0), (5.0, 1.8), (80.0, 50.0), (None, 180.0), (80.0, 1.0), (80.0, 2.5)]
    df = spark.createDataFrame(rows, "w double, h double")
    got = [r[0] for r in df.select(clinical.body_mass_index(F.col("w"), F.col("h"))).collect()]
    assert got == [24.69, 24.69, None, None, None, None, None]


def test_fio2_and_severity(spark):
    assert column(spark, [50.0, 1.0, 0.4, 0.0], "double", lambda c: clinical.fio2_fraction(c, F.lit(60.0))) == [
        0.5, 1.0, 0.4, 0.6,
    ]
    assert column(spark, [100.0, 100.1, 200.0, 300.0, 301.0, None], "double", clinical.severity_band) == [
        1, 2, 2, 3, 4, None,
    ]


@pytest.mark.parametrize(
    ("unit", "hospital", "unit_place", "hospital_place", "unit_days", "hospital_days", "code"),
    [
        ("Alive", "Alive", None, None, 3, 5, -1),
        ("Expired", "Expired", None, None, 10, 12, 0),
        ("Expired", "Expired", None, "Home", 10, 12, 1),
        ("Expired", "Expired", None, "Home", 30, 32, 3),
        ("Alive", "Expired", "Floor", None, 5, 27, 1),
        ("Alive", "Expired", "Floor", None, 5, 28, 2),
        ("Alive", "Expired", None, None, 5, 40, 2),
        (None, "Expired", "Home", None, 5, 40, 3),
        (None, None, None, None, 1, 1, -1),
    ],
)
def test_death_detail(spark, unit, hospital, unit_place, hospital_place, unit_days, hospital_days, code):
    df = spark.createDataFrame(
        [(unit, hospital, unit_place, hospital_place, unit_days, hospital_days)],
        "us string, hs string, ul string, hl string, ud int, hd int",
    )
    cols = [F.col(c) for c in ("us", "hs", "ul", "hl", "ud", "hd")]
    assert df.select(clinical.death_detail(*cols)).first()[0] == code


@pytest.mark.parametrize(
    ("hypoxic", "unit", "hospital", "unit_min", "hospital_min", "status"),
    [
        (True, "Expired", "Expired", 0, 0, 1),
        (None, "Expired", "Expired", 2440, 9999, 2),
        (False, "Alive", "Expired", 5000, 2440, 2),
        (False, "Alive", "Alive", 2440, 9999, 0),
        (False, None, None, 9999, 100, 0),
        (False, "Expired", "Alive", 9999, 100, 0),
        (False, "Alive", "Alive", 2441, 9999, 1),
    ],
)
def test_outcome_class(spark, hypoxic, unit, hospital, unit_min, hospital_min, status):
    df = spark.createDataFrame(
        [(hypoxic, unit, hospital, unit_min, hospital_min, 1000)],
        "h boolean, us string, hs string, um int, hm int, e int",
    )
    cols = [F.col(c) for c in ("h", "us", "hs", "um", "hm", "e")]
    assert df.select(clinical.outcome_class(*cols)).first()[0] == status


def test_header_contract(spark):
    header = rules.feature_header()
    check_header(header, 206)
    assert header[0] == "id" and header[40:42] == ["BMI", "admission_score"]
    assert header[42] == "pH_median" and header[-5:] == rules.OUTCOME_COLUMNS
    at = header.index("GCS Total_changerate")
    assert header[at : at + 3] == ["GCS Total_changerate", "GCS Total_median", "GCS Total_variances"]
    with pytest.raises(ValueError, match="duplicate"):
        check_header(["a", "A"])
    with pytest.raises(ValueError, match="expected 3"):
        check_header(["a"], 3)


def test_schema_contract(spark):
    from breathline.sources.schemas import measurement_schema

    df = spark.createDataFrame([(1.0, "a", 2, 3)], "value double, name string, offset_min int, stay_id bigint")
    assert check_schema(df, measurement_schema()).columns == measurement_schema().names
    with pytest.raises(ValueError, match="missing value"):
        check_schema(df.drop("value"), measurement_schema())
    with pytest.raises(ValueError, match="value is string"):
        check_schema(df.withColumn("value", F.lit("x")), measurement_schema())


def test_disease_flags(spark):
    rows = [
        (1, "CABG with valve repair"), (1, "Cardiac arrest, other"), (2, "Aortic valve replacement"),
        (3, "Neuro check"), (4, None), (5, "Edema, pulmonary (ARDS)"),
    ]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r for r in flag_pivot(df, "k", "t", rules.DISEASES, rules.DISEASE_EXCEPTIONS).collect()}
    assert len(got[1]) == 27
    assert (got[1].Valve_Disease, got[1].others_diease, got[1].Cardiac_Arrest) == (0, 1, 1)
    assert (got[2].Valve_Disease, got[3].Neurologic, got[5].Respiratory_Medical_Other) == (1, 1, 1)
    assert sum(got[4][1:]) == 0
