"""From the clinical relations to the feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.functions.rules import FIO2, PAO2
from breathline.plans.cohort import clinical_cohort
from breathline.plans.features import feature_table
from breathline.plans.outcomes import clinical_discharges, label_outcomes
from breathline.session import cut_lineage
from breathline.sources.tables import as_measurements


@dataclass(frozen=True)
class Study:
    cohort: DataFrame
    outcomes: DataFrame
    features: DataFrame


def study_tables(tables: dict[str, DataFrame]) -> Study:
    """Cohort, outcome labels and the 206-column feature table.

    The cohort (one small row per stay) is written once, because every feature
    source and the outcomes join it.
    """
    cohort = cut_lineage(clinical_cohort(tables).cohort)
    lab = tables["lab"].filter(F.col("labname").isin(PAO2, FIO2))
    series = as_measurements(
        lab, "patientunitstayid", "labresultoffset", F.col("labname"), F.col("labresult")
    )
    outcomes = label_outcomes(cohort, clinical_discharges(tables["patient"]), series)
    return Study(cohort, outcomes, feature_table(tables, cohort, outcomes))
