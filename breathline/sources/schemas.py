"""Declared schemas of the clinical relations and of the working tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Relation -> the columns read, as DDL.
RELATIONS = {
    "patient": (
        "patientunitstayid BIGINT, age STRING, gender STRING, hospitaladmitsource STRING, "
        "admissionweight DOUBLE, admissionheight DOUBLE, apacheadmissiondx STRING, "
        "unitdischargestatus STRING, hospitaldischargestatus STRING, unitdischargelocation STRING, "
        "hospitaldischargelocation STRING, unitdischargeoffset INT, hospitaldischargeoffset INT, "
        "hospitaladmitoffset INT, hospitaladmittime24 STRING"
    ),
    "diagnosis": "patientunitstayid BIGINT, icd9code STRING, diagnosisstring STRING, diagnosisoffset INT",
    "admissiondx": (
        "patientunitstayid BIGINT, admitdxpath STRING, admitdxname STRING, admitdxenteredoffset INT"
    ),
    "apacheapsvar": (
        "patientunitstayid BIGINT, pao2 DOUBLE, fio2 DOUBLE, hematocrit DOUBLE, albumin DOUBLE"
    ),
    "apachepatientresult": "patientunitstayid BIGINT, apachescore INT",
    "lab": "patientunitstayid BIGINT, labname STRING, labresult DOUBLE, labresultoffset INT",
    "customlab": (
        "patientunitstayid BIGINT, labothername STRING, labotherresult STRING, labotheroffset INT"
    ),
    "nursecharting": (
        "patientunitstayid BIGINT, nursingchartcelltypevalname STRING, nursingchartvalue STRING, "
        "nursingchartoffset INT"
    ),
    "respiratorycharting": (
        "patientunitstayid BIGINT, respchartid BIGINT, respchartvaluelabel STRING, "
        "respchartvalue STRING, respchartoffset INT, respchartentryoffset INT"
    ),
    "physicalexam": (
        "patientunitstayid BIGINT, physicalexamvalue STRING, physicalexamtext STRING, "
        "physicalexamoffset INT"
    ),
    "vitalperiodic": (
        "patientunitstayid BIGINT, observationoffset INT, padiastolic DOUBLE, pasystolic DOUBLE, "
        "pamean DOUBLE, cvp DOUBLE, temperature DOUBLE, sao2 DOUBLE, heartrate DOUBLE, "
        "respiration DOUBLE, etco2 DOUBLE"
    ),
    "admissiondrug": "patientunitstayid BIGINT, drugname STRING, drugenteredoffset INT",
    "medication": (
        "patientunitstayid BIGINT, drugname STRING, drugstartoffset INT, drugstopoffset INT"
    ),
    "infusiondrug": "patientunitstayid BIGINT, drugname STRING, infusionoffset INT",
    "treatment": "patientunitstayid BIGINT, treatmentstring STRING, treatmentoffset INT",
}

MEASUREMENT_DDL = "stay_id BIGINT, offset_min INT, name STRING, value DOUBLE"


def relation_schema(name: str) -> StructType:
    return StructType.fromDDL(RELATIONS[name])


def measurement_schema() -> StructType:
    return StructType.fromDDL(MEASUREMENT_DDL)
