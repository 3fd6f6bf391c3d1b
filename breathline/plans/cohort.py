"""Cohort selection: who is in, from when, and how severe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.functions.clinical import MILD_PF, fio2_fraction, is_adult, severity_band
from breathline.functions.numeric import enrollment_from_onset, safe_ratio
from breathline.functions.rules import (
    FIO2,
    HEART_FAILURE_PATH,
    LOW_FLOW_LABEL,
    LOW_FLOW_LPM,
    PAO2,
    PEEP,
    PEEP_MINIMUM,
    RESPIRATORY_FAILURE_ICD9,
    RESPIRATORY_FAILURE_PATH,
    ROOM_AIR_FIO2,
    SUSTAIN_MINUTES,
    VENT_LABEL,
    VENT_VALUES,
)
from breathline.functions.text import like_any, number_above, to_number
from breathline.operators.joins import clipped, common_ids, flag_low_peep, subtract_ids, with_ids, without_ids
from breathline.operators.reshape import union_distinct
from breathline.operators.series import pf_onset
from breathline.session import cut_lineage
from breathline.sources.tables import as_measurements

ID = "patientunitstayid"


def adult_ids(patient: DataFrame, minimum: int = 18) -> DataFrame:
    return patient.filter(is_adult(F.col("age"), minimum)).select(F.col(ID).alias("stay_id"))


def ventilated_ids(respiratorycharting: DataFrame) -> DataFrame:
    """Ventilator on, or FiO2 above room air, and not on low-flow oxygen."""
    label, value = F.col("respchartvaluelabel"), F.col("respchartvalue")
    ids = respiratorycharting.withColumnRenamed(ID, "stay_id")
    on_vent = ids.filter((label == VENT_LABEL) & value.isin(VENT_VALUES))
    enriched = ids.filter((label == FIO2) & number_above(value, ROOM_AIR_FIO2))
    low_flow = ids.filter((label == LOW_FLOW_LABEL) & (to_number(value) <= LOW_FLOW_LPM))
    return subtract_ids([on_vent, enriched], low_flow, "stay_id")


def respiratory_failure_ids(diagnosis: DataFrame) -> DataFrame:
    """Stays coded with respiratory failure."""
    hit = like_any(F.col("icd9code"), RESPIRATORY_FAILURE_ICD9)
    return diagnosis.filter(hit).select(F.col(ID).alias("stay_id")).distinct()


def respiratory_failure_without_heart_failure(
    base: DataFrame, diagnosis: DataFrame, admissiondx: DataFrame
) -> DataFrame:
    """Rows of ``base`` with respiratory failure and without heart failure in either text."""

    def ids(pattern: str) -> list[DataFrame]:
        return [
            diagnosis.filter(F.col("diagnosisstring").like(pattern)),
            admissiondx.filter(F.col("admitdxpath").like(pattern)),
        ]

    failing = with_ids(base, ids(RESPIRATORY_FAILURE_PATH), ID)
    return without_ids(failing, ids(HEART_FAILURE_PATH), ID)


def oxygenation_measurements(
    lab: DataFrame, respiratorycharting: DataFrame | None = None, physicalexam: DataFrame | None = None
) -> DataFrame:
    """Distinct paO2 and FiO2 rows after admission from up to three relations."""
    parts = [
        as_measurements(
            lab.filter(F.col("labname").isin(PAO2, FIO2) & (F.col("labresultoffset") > 0)),
            ID, "labresultoffset", F.col("labname"), F.col("labresult"),
        )
    ]
    if respiratorycharting is not None:
        rows = respiratorycharting.filter(
            (F.col("respchartvaluelabel") == FIO2) & (F.col("respchartoffset") > 0)
        )
        parts.append(
            as_measurements(
                rows, ID, "respchartoffset", F.lit(FIO2), to_number(F.col("respchartvalue"))
            ).filter(F.col("value").isNotNull())
        )
    if physicalexam is not None:
        rows = physicalexam.filter(
            F.lower("physicalexamvalue").contains(FIO2.lower()) & (F.col("physicalexamoffset") > 0)
        )
        parts.append(
            as_measurements(
                rows, ID, "physicalexamoffset", F.lit(FIO2), to_number(F.col("physicalexamtext"))
            ).filter(F.col("value").isNotNull())
        )
    return union_distinct(parts, ["stay_id", "offset_min", "name", "value"])


def peep_supported_ids(
    lab: DataFrame, respiratorycharting: DataFrame, physicalexam: DataFrame, minimum: float = PEEP_MINIMUM
) -> DataFrame:
    """Stays with a PEEP of at least ``minimum`` in any of three relations."""

    def hits(df: DataFrame, name: str, value: Column) -> DataFrame:
        wanted = F.lower(F.col(name)).contains(PEEP.lower()) & (value >= minimum)
        return df.filter(wanted).select(F.col(ID).alias("stay_id"))

    return union_distinct(
        [
            hits(lab, "labname", F.col("labresult")),
            hits(respiratorycharting, "respchartvaluelabel", to_number(F.col("respchartvalue"))),
            hits(physicalexam, "physicalexamvalue", to_number(F.col("physicalexamtext"))),
        ],
        ["stay_id"],
    )


def admission_or_course_onset(
    admission: DataFrame,
    measurements: DataFrame,
    threshold: float = MILD_PF,
    sustain: int = SUSTAIN_MINUTES,
    lookback: int = SUSTAIN_MINUTES,
) -> DataFrame:
    """(stay_id, onset, severity, at_admission) of stays that qualify.

    A stay whose admission ratio is at or under ``threshold`` has onset 0; its
    severity is that of the pairs in [-lookback, 0), or of the admission ratio
    if there is no pair or none in a band. All other stays need a sustained
    onset over their whole course. ``admission`` has (stay_id, pao2, fio2).
    """
    first = (
        admission.filter((F.col("pao2") > 0) & (F.col("fio2") > 0))
        .withColumn("pf", safe_ratio(F.col("pao2"), fio2_fraction(F.col("fio2"))))
        .groupBy("stay_id")
        .agg(F.min("pf").alias("admission_pf"))
        .filter(F.col("admission_pf") <= threshold)
    )
    before = pf_onset(clipped(measurements, "offset_min", -lookback, 0), threshold, sustain)
    at_admission = first.join(before.select("stay_id", "severity"), "stay_id", "left").select(
        "stay_id",
        F.lit(0).cast("bigint").alias("onset"),
        F.coalesce(
            F.when(F.col("severity") <= 3, F.col("severity")), severity_band(F.col("admission_pf"))
        ).alias("severity"),
        F.lit(1).alias("at_admission"),
    )
    course = (
        pf_onset(measurements, threshold, sustain)
        .filter(F.col("onset").isNotNull())
        .join(first, "stay_id", "left_anti")
        .select("stay_id", "onset", "severity", F.lit(0).alias("at_admission"))
    )
    return at_admission.unionByName(course)


@dataclass(frozen=True)
class Funnel:
    """Stages of the selection as lazy frames, narrowing from first to last.

    ``checked`` holds the stays with an onset and whether their PEEP was too low.
    """

    adults: DataFrame
    eligible: DataFrame
    checked: DataFrame

    @property
    def cohort(self) -> DataFrame:
        """(stay_id, onset, severity, at_admission, enrollment)."""
        kept = self.checked.filter(~F.col("low_peep")).drop("low_peep")
        return kept.withColumn("enrollment", enrollment_from_onset(F.col("onset")))

    def counts(self) -> DataFrame:
        """(step, stage, stays): one pass over the stages joined on the stay."""
        eligible = self.eligible.withColumn("eligible", F.lit(1))
        stays = self.adults.join(eligible, "stay_id", "left").join(
            self.checked.select("stay_id", "low_peep"), "stay_id", "left"
        )
        row = stays.agg(
            F.count(F.lit(1)).alias("adult"),
            F.count("eligible").alias("eligible"),
            F.count("low_peep").alias("onset"),
            F.count(F.when(~F.col("low_peep"), 1)).alias("cohort"),
        )
        stages = ["adult", "eligible", "onset", "cohort"]
        steps = F.array(
            *[
                F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("stays"))
                for i, s in enumerate(stages)
            ]
        )
        return row.select(F.inline(steps))


def cohort_funnel(
    adults: DataFrame,
    id_sets: list[DataFrame],
    admission: DataFrame,
    measurements: DataFrame,
    threshold: float = MILD_PF,
    sustain: int = SUSTAIN_MINUTES,
    peep_minimum: float = PEEP_MINIMUM,
) -> Funnel:
    """Adults in every id set -> oxygenation onset -> PEEP check -> enrollment.

    The eligible ids, their measurements and the onsets are read by several
    branches; they are written to the checkpoint folder once. Ids of stays grow
    with the tables, whatever the size of their files, so they are not broadcast.
    """
    adults = adults.select("stay_id").distinct()
    eligible = cut_lineage(common_ids([adults, *id_sets], "stay_id"))
    own = cut_lineage(measurements.join(eligible.hint("merge"), "stay_id", "left_semi"))
    onsets = cut_lineage(
        admission_or_course_onset(
            admission.join(eligible.hint("merge"), "stay_id", "left_semi"), own, threshold, sustain
        )
    )
    checked = flag_low_peep(own, onsets, minimum=peep_minimum, lookback=sustain)
    return Funnel(adults, eligible, checked)


def clinical_cohort(tables: dict[str, DataFrame]) -> Funnel:
    """The funnel over the clinical relations."""
    lab = tables["lab"]
    measurements = as_measurements(
        lab.filter(F.col("labname").isin(PAO2, FIO2, PEEP)),
        ID, "labresultoffset", F.col("labname"), F.col("labresult"),
    )
    admission = tables["apacheapsvar"].select(F.col(ID).alias("stay_id"), "pao2", "fio2")
    failing = respiratory_failure_ids(tables["diagnosis"])
    no_heart_failure = without_ids(
        failing,
        [
            tables["diagnosis"].filter(F.col("diagnosisstring").like(HEART_FAILURE_PATH))
            .select(F.col(ID).alias("stay_id")),
            tables["admissiondx"].filter(F.col("admitdxpath").like(HEART_FAILURE_PATH))
            .select(F.col(ID).alias("stay_id")),
        ],
        "stay_id",
    )
    return cohort_funnel(
        adult_ids(tables["patient"]),
        [ventilated_ids(tables["respiratorycharting"]), no_heart_failure],
        admission,
        measurements,
    )
