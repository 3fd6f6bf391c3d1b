"""The wide feature row of each cohort stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.functions import rules
from breathline.functions.clinical import admit_source_code, age_years, body_mass_index, gender_code
from breathline.functions.text import has_digit, to_number
from breathline.operators.distribution import feature_statistics
from breathline.operators.joins import clipped, interval_join, rename_synonyms
from breathline.operators.reshape import (
    flag_columns,
    flag_pivot,
    merge_flags,
    pivot_statistics,
    select_header,
    union_sources,
    unpivot_positive,
)
from breathline.operators.series import SeriesColumns, pair_series
from breathline.session import cut_lineage
from breathline.sources.tables import as_measurements

ID = "patientunitstayid"
LONG_COLUMNS = ["stay_id", "offset_min", "name", "value"]


def dynamic_measurements(tables: dict[str, DataFrame]) -> DataFrame:
    """All feature measurements of all relations in the long layout.

    The one-off hematocrit of the admission score sits at minute 0 and is kept
    apart by ``any_time``, as it is not bound to the stay's window.
    """
    lab = tables["lab"].filter((F.col("labresult") > 0) & F.col("labname").isin(rules.LAB_NAMES))
    custom = tables["customlab"].filter(F.col("labothername").like(rules.CUSTOM_LAB_PATTERN))
    nurse = tables["nursecharting"].filter(
        F.col("nursingchartcelltypevalname").isin(rules.NURSING_NAMES) & has_digit(F.col("nursingchartvalue"))
    )
    resp = tables["respiratorycharting"].filter(
        F.col("respchartvaluelabel").isin(rules.RESPIRATORY_NAMES) & has_digit(F.col("respchartvalue"))
    )
    vital = unpivot_positive(tables["vitalperiodic"], [ID, "observationoffset"], rules.VITAL_COLUMNS)
    once = tables["apacheapsvar"].filter(F.col("hematocrit") > 0).withColumn("at", F.lit(0))
    timed = union_sources(
        [
            as_measurements(lab, ID, "labresultoffset", F.col("labname"), F.col("labresult")),
            as_measurements(
                custom, ID, "labotheroffset", F.col("labothername"), to_number(F.col("labotherresult"))
            ),
            as_measurements(
                nurse, ID, "nursingchartoffset",
                F.col("nursingchartcelltypevalname"), to_number(F.col("nursingchartvalue")),
            ),
            as_measurements(
                resp, ID, "respchartoffset", F.col("respchartvaluelabel"), to_number(F.col("respchartvalue"))
            ),
            as_measurements(vital, ID, "observationoffset", F.col("name"), F.col("value")),
        ],
        LONG_COLUMNS,
    ).withColumn("any_time", F.lit(False))
    single = as_measurements(once, ID, "at", F.lit("hematocrit"), F.col("hematocrit"))
    return timed.unionByName(single.withColumn("any_time", F.lit(True)))


def with_ratio_series(measurements: DataFrame) -> DataFrame:
    """Add the paired oxygenation ratio as one more measurement."""
    pairs = pair_series(measurements, fill="nonpositive")
    ratio = pairs.select(
        "stay_id", F.col("offset_min").cast("int").alias("offset_min"),
        F.lit(rules.PF_RATIO).alias("name"), F.col("pf").alias("value"),
    )
    return measurements.select(*LONG_COLUMNS).unionByName(ratio)


def window_statistics(measurements: DataFrame, cohort: DataFrame) -> DataFrame:
    """Statistics per (stay, measurement) between onset and enrollment."""
    windows = cohort.select("stay_id", "onset", "enrollment")
    inside = interval_join(measurements, windows, "onset", "enrollment").select(*LONG_COLUMNS)
    return measurement_statistics(inside)


def measurement_statistics(inside: DataFrame) -> DataFrame:
    """Statistics of the rows inside the windows and of their ratio series.

    The rows are written to the checkpoint folder first: they are few, and
    reading them twice must not scan and join the whole tables twice.
    """
    inside = cut_lineage(inside)
    return feature_statistics(rename_synonyms(with_ratio_series(inside), rules.SYNONYMS))


def dynamic_features(tables: dict[str, DataFrame], cohort: DataFrame) -> DataFrame:
    """One row per cohort stay that has measurements: 53 x 3 statistics."""
    rows = dynamic_measurements(tables)
    timed = interval_join(
        rows.filter(~F.col("any_time")).select(*LONG_COLUMNS),
        cohort.select("stay_id", "onset", "enrollment"),
        "onset",
        "enrollment",
    ).select(*LONG_COLUMNS)
    single = rows.filter("any_time").select(*LONG_COLUMNS).join(
        cohort.select("stay_id").hint("merge"), "stay_id", "left_semi"
    )
    stats = measurement_statistics(timed.unionByName(single))
    return pivot_statistics(stats, "stay_id", rules.FEATURE_MEASUREMENTS)


def drug_flags(tables: dict[str, DataFrame], cohort: DataFrame) -> DataFrame:
    """Drug flags inside the window, the largest over three relations."""
    windows = cohort.select(F.col("stay_id").alias(ID), "onset", "enrollment")

    def inside(name: str, time: str) -> DataFrame:
        return interval_join(
            tables[name], windows, "onset", "enrollment", SeriesColumns(stay=ID, time=time)
        )

    admission = flag_pivot(inside("admissiondrug", "drugenteredoffset"), ID, "drugname", rules.ADMISSION_DRUGS)
    given = inside("medication", "drugstartoffset").filter(F.col("drugstopoffset") < F.col("enrollment"))
    medication = given.groupBy(ID).agg(
        *flag_columns(F.col("drugname"), rules.MEDICATION_DRUGS),
        *flag_columns(F.lower("drugname"), rules.MEDICATION_DRUGS_ANY_CASE),
    )
    treated = flag_pivot(inside("treatment", "treatmentoffset"), ID, "treatmentstring", rules.TREATMENT_FLAGS)
    return merge_flags([admission, medication, treated], ID, rules.DRUG_FLAGS).withColumnRenamed(ID, "stay_id")


def infusion_flags(infusiondrug: DataFrame, low: int = 0, high: int = 1440) -> DataFrame:
    """Drug flags of infusions at minutes low..high of the stay."""
    rows = clipped(infusiondrug, "infusionoffset", low, high + 1)
    return flag_pivot(rows, ID, "drugname", rules.INFUSION_DRUGS)


def course_diagnosis_flags(diagnosis: DataFrame, low: int = 0, high: int = 1440) -> DataFrame:
    """Disease flags of diagnoses made at minutes low..high of the stay."""
    rows = clipped(diagnosis, "diagnosisoffset", low, high + 1)
    return flag_pivot(rows, ID, "diagnosisstring", rules.COURSE_DIAGNOSES)


def static_features(tables: dict[str, DataFrame], cohort: DataFrame) -> DataFrame:
    """Flags, demographics and admission score of each cohort stay."""
    ids = cohort.select("stay_id")
    patient = tables["patient"].withColumnRenamed(ID, "stay_id").join(ids.hint("merge"), "stay_id", "left_semi")
    disease = flag_pivot(patient, "stay_id", "apacheadmissiondx", rules.DISEASES, rules.DISEASE_EXCEPTIONS)
    person = patient.groupBy("stay_id").agg(
        F.max(admit_source_code(F.col("hospitaladmitsource"))).alias("admitsource"),
        F.max(age_years(F.col("age"))).alias("age"),
        F.max(gender_code(F.col("gender"))).alias("gender"),
        F.max(body_mass_index(F.col("admissionweight"), F.col("admissionheight"))).alias("BMI"),
    )
    score = (
        tables["apachepatientresult"].filter(F.col("apachescore") > 0)
        .groupBy(F.col(ID).alias("stay_id"))
        .agg(F.max("apachescore").alias("admission_score"))
    )
    out = ids
    # a side has a row per stay and many columns, of which an estimate from its files knows nothing: no broadcast
    for side in (drug_flags(tables, cohort), disease, person, score):
        out = out.join(side.hint("merge"), "stay_id", "left")
    flags = [*rules.DRUG_FLAGS, *rules.DISEASES]
    return out.fillna(0, subset=flags)


def feature_table(tables: dict[str, DataFrame], cohort: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The 206-column table; anything not measured is NULL.

    ``outcomes`` has (stay_id, status, detail, unit, hospital).
    """
    wide = (
        cohort.select("stay_id", "severity")
        .join(static_features(tables, cohort).hint("merge"), "stay_id", "left")
        .join(dynamic_features(tables, cohort).hint("merge"), "stay_id", "left")
        .join(outcomes.hint("merge"), "stay_id", "left")
        .withColumnRenamed("stay_id", "id")
    )
    return select_header(wide, rules.feature_header())
