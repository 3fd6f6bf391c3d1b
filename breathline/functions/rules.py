"""Rule catalogues as data: measurements, synonyms, drug and disease flags.

Everything in this module is a fixed value: names and patterns must equal those
of the clinical source for results to be right.
"""

from __future__ import annotations

PAO2, FIO2, PEEP, PF_RATIO = "paO2", "FiO2", "PEEP", "P/F ratio"

# Other spellings of a measurement -> its catalogue name.
SYNONYMS = {
    "Carboxyhemoglobin": "Hemoglobin",
    "Methemoglobin": "Hemoglobin",
    "HCO3": "bicarbonate",
    "bedside glucose": "glucose",
    "EtCO2": "etCO2",
    "ETCO2": "etCO2",
}

# Laboratory measurements.
LAB_NAMES = [
    "albumin", "ALT (SGPT)", "PT - INR", "AST (SGOT)", "-bands", "Base Excess", "-basos",
    "bicarbonate", "HCO3", "total bilirubin", "BUN", "calcium", "Total CO2", "creatinine",
    "-eos", "FiO2", "glucose", "bedside glucose", "Carboxyhemoglobin", "Methemoglobin",
    "ionized calcium", "lactate", "magnesium", "paCO2", "paO2", "PEEP", "pH",
    "platelets x 1000", "potassium", "PTT", "sodium", "Temperature", "WBC x 1000",
]

# Nurse charting and respiratory charting measurements.
NURSING_NAMES = [
    "Eyes", "GCS Total", "Motor", "Verbal", "Heart Rate",
    "Non-Invasive BP Diastolic", "Non-Invasive BP Mean", "Non-Invasive BP Systolic",
    "Invasive BP Diastolic", "Invasive BP Mean", "Invasive BP Systolic", "Respiratory Rate",
]
RESPIRATORY_NAMES = [
    "Mean Airway Pressure", "SaO2", "EtCO2", "ETCO2", "TV/kg IBW", "Plateau Pressure",
]
VITAL_COLUMNS = ["padiastolic", "pasystolic", "pamean", "cvp"]
CUSTOM_LAB_PATTERN = "%PIP%"

# The measurements of the feature row, in header order.
FEATURE_MEASUREMENTS = [
    "pH", "paO2", "paCO2", "Base Excess", "bicarbonate", "lactate", "glucose", "WBC x 1000",
    "-basos", "-eos", "-bands", "Hemoglobin", "hematocrit", "platelets x 1000", "AST (SGOT)",
    "ALT (SGPT)", "total bilirubin", "albumin", "cvp", "BUN", "creatinine", "PT - INR", "PTT",
    "FiO2", "PEEP", "Plateau Pressure", "Mean Airway Pressure", "TV/kg IBW", "Respiratory Rate",
    "P/F ratio", "GCS Total", "Eyes", "Motor", "Verbal", "calcium", "ionized calcium",
    "magnesium", "potassium", "sodium", "Total CO2", "etCO2", "SaO2", "Temperature",
    "Heart Rate", "padiastolic", "pamean", "pasystolic", "Invasive BP Diastolic",
    "Invasive BP Mean", "Invasive BP Systolic", "Non-Invasive BP Diastolic",
    "Non-Invasive BP Mean", "Non-Invasive BP Systolic",
]
STATISTICS = ["median", "variances", "changerate"]

# Drug flags; (flag, LIKE patterns) per source relation.
ADMISSION_DRUGS = {
    "warfarin": ["%WARFARIN SODIUM%"],
    "dobutamine": ["DOBUTAMINE HCL%"],
    "Dopamine": ["DOPAMINE HCL%"],
    "epinephrine": ["EPINEPHRINE%"],
    "Heparin": ["HEPARIN%"],
    "Milrinone": ["MILRINONE%"],
    "Norepinephrine": ["NOREPINEPHRINE%"],
    "phenylephrine": ["%PHENYLEPHRINE%"],
}
MEDICATION_DRUGS = {
    "warfarin": ["warfarin"],
    "Dopamine": ["DOPamine"],
    "epinephrine": ["EPINEPHrine"],
    "vasopressin": ["VASOPRESSIN%"],
}
MEDICATION_DRUGS_ANY_CASE = {
    "Heparin": ["heparin%"],
    "Norepinephrine": ["%norepinephrine%"],
    "phenylephrine": ["%phenylephrine%"],
}
INFUSION_DRUGS = {
    "dobutamine": ["Dobutamine%"],
    "Dopamine": ["Dopamine%"],
    "epinephrine": ["epinephrine%"],
    "Heparin": ["Heparin%"],
    "Milrinone": ["Milrinone%"],
    "Norepinephrine": ["Norepinephrine%"],
    "phenylephrine": ["Phenylephrine%"],
    "vasopressin": ["Vasopressin%"],
}
TREATMENT_FLAGS = {"Vasopressor": ["%vasopressor%"]}
DRUG_FLAGS = [
    "warfarin", "dobutamine", "Dopamine", "epinephrine", "Heparin", "Milrinone",
    "Norepinephrine", "phenylephrine", "vasopressin", "Vasopressor",
]

# Disease flags on the admission diagnosis; case matters.
DISEASES = {
    "Acute_Coronary_Syndrome_diagnosis": ["%Angina, unstable%"],
    "Acute_Myocardial_Infarction": ["%MI%"],
    "Acute_Renal_Failure": ["%Renal %"],
    "Arrhythmia": ["%Rhythm%"],
    "Asthma_Emphysema": ["%Asthma%", "%Emphysema%"],
    "Cancer": ["%Cancer%", "%Leukemia,%"],
    "Cardiac_Arrest": ["%Cardiac arrest%"],
    "Cardiogenic_Shock": ["%Shock, cardiogenic%"],
    "Cardiovascular_Medical": ["%Cardiovascular medical%"],
    "Cardiovascular_Other": ["%Angina, stable%", "%Pericardi%"],
    "Cerebrovascular_Accident_Stroke": ["%cerebrovascular%", "%Hemorrhage/%"],
    "Chest_Pain_Unknown_Origin": ["%Chest pain,%"],
    "Coma": ["%Coma/change%", "%Nontraumatic coma%"],
    "Coronary_Artery_Bypass_Graft": ["%CABG%"],
    "Diabetic_Ketoacidosis": ["%Diabetic%"],
    "Gastrointestinal_Bleed": ["%Bleeding%", "%GI perforation/%"],
    "Gastrointestinal_Obstruction": ["%GI obstruction%"],
    "Neurologic": ["%,neurologic%", "%Neoplasm%", "%Seizures%", "Neuro%"],
    "Overdose": ["%Overdose,%", "%Toxicity, drug%"],
    "Pneumonia": ["%Pneumonia,%"],
    "Respiratory_Medical_Other": ["%Apnea%", "%respiratory distress%", "%edema%", "%pulmonary%"],
    "Sepsis": ["%Sepsis,%"],
    "Thoracotomy": ["%Thoracotomy%"],
    "Trauma": ["%trauma%"],
    "Valve_Disease": ["%valve%"],
    "others_diease": ["%, other"],
}
DISEASE_EXCEPTIONS = {"Valve_Disease": ["%CABG%"]}

# Disease flags on the course diagnosis path.
COURSE_DIAGNOSES = {
    "Acute_Coronary_Syndrome_diagnosis": ["%acute coronary syndrome%"],
    "Acute_Myocardial_Infarction": ["%acute myocardial infarction%"],
    "Acute_Renal_Failure": ["%acute renal failure%"],
    "Arrhythmia": ["%arrhythmia%"],
    "Asthma_Emphysema": ["%asthma%"],
    "Cancer": ["%cancer%"],
    "Cardiac_Arrest": ["%cardiac arrest%"],
    "Cardiogenic_Shock": ["%cardiogenic shock%"],
    "Cardiovascular_Medical": ["%cardiovascular%"],
    "Cardiovascular_Other": ["%pericardial%"],
    "Cerebrovascular_Accident_Stroke": ["%stroke%"],
    "Chest_Pain_Unknown_Origin": ["%chest pain%"],
    "Coma": ["%coma%"],
    "Coronary_Artery_Bypass_Graft": ["%CABG%"],
    "Diabetic_Ketoacidosis": ["%ketoacidosis%"],
    "Gastrointestinal_Bleed": ["%bleeding%"],
    "Gastrointestinal_Obstruction": ["%GI obstruction%"],
    "Neurologic": ["%neurologic%"],
    "Overdose": ["%overdose%"],
    "Pneumonia": ["%pneumonia%"],
    "Respiratory_Medical_Other": ["%respiratory failure%"],
    "Sepsis": ["%sepsis%"],
    "Thoracotomy": ["%thoracotomy%"],
    "Trauma": ["%trauma%"],
    "Valve_Disease": ["%valve%"],
}

# Cohort rules.
RESPIRATORY_FAILURE_ICD9 = ["%518.81%", "%518.83%", "%518.84%"]
RESPIRATORY_FAILURE_PATH = "%respiratory failure%"
HEART_FAILURE_PATH = "%congestive heart failure%"
VENT_LABEL, VENT_VALUES = "RT Vent On/Off", ["Continued", "Start"]
LOW_FLOW_LABEL, LOW_FLOW_LPM, ROOM_AIR_FIO2 = "LPM O2", 3.0, 21.0
PEEP_MINIMUM = 5.0
SUSTAIN_MINUTES = 480

STATIC_TAIL = ["admitsource", "age", "gender", "BMI", "admission_score"]
OUTCOME_COLUMNS = ["status", "detail", "severity", "unit", "hospital"]


def statistic_columns(measurement: str) -> list[str]:
    """The three statistics of one measurement; one of them has its own order."""
    order = ["changerate", "median", "variances"] if measurement == "GCS Total" else STATISTICS
    return [f"{measurement}_{s}" for s in order]


def static_header() -> list[str]:
    return [*DRUG_FLAGS, *DISEASES, *STATIC_TAIL]


def measurement_header() -> list[str]:
    return [c for m in FEATURE_MEASUREMENTS for c in statistic_columns(m)]


def feature_header() -> list[str]:
    """id, 41 static, 159 measurement and 5 outcome columns."""
    return ["id", *static_header(), *measurement_header(), *OUTCOME_COLUMNS]
