"""Outcome labels of cohort stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.functions.clinical import DAY_MINUTES, MILD_PF, death_detail, outcome_class, stay_days
from breathline.functions.rules import FIO2, PAO2, SUSTAIN_MINUTES
from breathline.operators.joins import interval_join
from breathline.operators.series import pf_onset


def persistent_hypoxia(
    measurements: DataFrame,
    cohort: DataFrame,
    delay: int = DAY_MINUTES,
    threshold: float = MILD_PF,
    sustain: int = SUSTAIN_MINUTES,
) -> DataFrame:
    """(stay_id) of stays with a sustained onset from enrollment + delay on."""
    windows = cohort.select("stay_id", (F.col("enrollment") + delay).alias("follow_from"))
    later = interval_join(
        measurements.filter(F.col("name").isin(PAO2, FIO2)), windows, "follow_from", None
    ).select(*measurements.columns)
    onset = pf_onset(later, threshold, sustain)
    return onset.filter(F.col("onset").isNotNull()).select("stay_id")


def label_outcomes(
    cohort: DataFrame,
    discharges: DataFrame,
    measurements: DataFrame,
    delay: int = DAY_MINUTES,
    threshold: float = MILD_PF,
    sustain: int = SUSTAIN_MINUTES,
    dead: str = "Expired",
    home: str = "Home",
) -> DataFrame:
    """(stay_id, status, detail, unit, hospital) of every cohort stay with a discharge row.

    ``discharges`` has one row per stay: unit_status, hospital_status,
    unit_location, hospital_location, unit_discharge, hospital_discharge,
    hospital_admit.
    """
    hypoxic = persistent_hypoxia(measurements, cohort, delay, threshold, sustain)
    hypoxic = hypoxic.withColumn("still_hypoxic", F.lit(True))
    rows = (
        cohort.select("stay_id", "enrollment")
        .join(discharges, "stay_id")
        .join(hypoxic, "stay_id", "left")
        .withColumn("unit", stay_days(F.col("unit_discharge")))
        .withColumn("hospital", stay_days(F.col("hospital_discharge"), F.col("hospital_admit")))
    )
    status = outcome_class(
        F.col("still_hypoxic"), F.col("unit_status"), F.col("hospital_status"),
        F.col("unit_discharge"), F.col("hospital_discharge"), F.col("enrollment"), dead,
    )
    detail = death_detail(
        F.col("unit_status"), F.col("hospital_status"), F.col("unit_location"),
        F.col("hospital_location"), F.col("unit"), F.col("hospital"), dead, home,
    )
    return rows.select("stay_id", status.alias("status"), detail.alias("detail"), "unit", "hospital")


def clinical_discharges(patient: DataFrame) -> DataFrame:
    """Discharge columns of the patient relation under the names used here."""
    return patient.select(
        F.col("patientunitstayid").alias("stay_id"),
        F.col("unitdischargestatus").alias("unit_status"),
        F.col("hospitaldischargestatus").alias("hospital_status"),
        F.col("unitdischargelocation").alias("unit_location"),
        F.col("hospitaldischargelocation").alias("hospital_location"),
        F.col("unitdischargeoffset").alias("unit_discharge"),
        F.col("hospitaldischargeoffset").alias("hospital_discharge"),
        F.col("hospitaladmitoffset").alias("hospital_admit"),
    )
