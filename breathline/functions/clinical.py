"""Clinical scalar rules: ages, body mass, oxygenation, admission and outcome codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from breathline.functions.numeric import POSITIVE, half_even, whole_days
from breathline.functions.text import has_digit, has_letter, to_number

# Oxygenation cut-offs (inclusive) and the minutes in the rules.
SEVERE_PF, MODERATE_PF, MILD_PF = 100, 200, 300
DAY_MINUTES = 1440
SHORT_STAY_DAYS = 28


def age_years(age_text: Column, unknown: int | None = 91) -> Column:
    """Top-coded text age: '> 89' is 90, text with a digit its number, else ``unknown``."""
    rest = F.lit(None if unknown is None else float(unknown)).cast("double")
    return (
        F.when(age_text == "> 89", F.lit(90.0))
        .when(has_digit(age_text), to_number(age_text))
        .otherwise(rest)
    )


def is_adult(age_text: Column, minimum: int = 18) -> Column:
    return F.coalesce(age_years(age_text, unknown=None) >= minimum, F.lit(False))


def admit_source_code(source: Column) -> Column:
    """Emergency Department 0, Operating Room 1, Floor 2, Direct Admit 3, other text 4."""
    return (
        F.when(source == "Emergency Department", 0)
        .when(source == "Operating Room", 1)
        .when(source == "Floor", 2)
        .when(source == "Direct Admit", 3)
        .when(has_letter(source), 4)
    )


def gender_code(gender: Column) -> Column:
    return F.when(gender == "Female", 0).otherwise(1)


def body_mass_index(weight_kg: Column, height: Column) -> Column:
    """BMI with the height unit detected: (1, 2.5) is metres, >= 100 centimetres, else NULL."""
    metres = F.when((height > 1) & (height < 2.5), height).when(height >= 100, height / 100)
    return F.when(weight_kg >= 10, half_even(weight_kg / F.pow(metres, F.lit(2)), 2))


def fio2_fraction(fio2: Column, mean_fio2: Column | None = None) -> Column:
    """Percent to fraction; a vanishing value becomes the (normalised) mean when one is given."""
    fraction = F.when(fio2 > 1, fio2 / 100).otherwise(fio2)
    if mean_fio2 is None:
        return fraction
    return F.when(fio2 < POSITIVE, fio2_fraction(mean_fio2)).otherwise(fraction)


def severity_band(pf: Column) -> Column:
    """1 severe, 2 moderate, 3 mild, 4 above every cut-off; NULL stays NULL."""
    return (
        F.when(pf <= SEVERE_PF, 1)
        .when(pf <= MODERATE_PF, 2)
        .when(pf <= MILD_PF, 3)
        .when(pf.isNotNull(), 4)
    )


def stay_days(discharge_min: Column, admit_min: Column | None = None) -> Column:
    return whole_days(discharge_min if admit_min is None else discharge_min - admit_min)


def outcome_class(
    still_hypoxic: Column,
    unit_status: Column,
    hospital_status: Column,
    unit_discharge_min: Column,
    hospital_discharge_min: Column,
    enrollment: Column,
    dead: str = "Expired",
) -> Column:
    """0 fast recovery, 1 long stay, 2 rapid death."""
    limit = enrollment + DAY_MINUTES
    unit_dead = unit_status.eqNullSafe(F.lit(dead))
    hospital_dead = hospital_status.eqNullSafe(F.lit(dead))
    left_unit = F.coalesce(unit_discharge_min <= limit, F.lit(False))
    left_hospital = F.coalesce(hospital_discharge_min <= limit, F.lit(False))
    return (
        F.when(F.coalesce(still_hypoxic, F.lit(False)), 1)
        .when((unit_dead & left_unit) | (hospital_dead & left_hospital), 2)
        .when((~unit_dead & left_unit) | (~hospital_dead & left_hospital), 0)
        .otherwise(1)
    )


def death_detail(
    unit_status: Column,
    hospital_status: Column,
    unit_location: Column,
    hospital_location: Column,
    unit_days: Column,
    hospital_days: Column,
    dead: str = "Expired",
    home: str = "Home",
) -> Column:
    """-1 alive, 0 in the unit, 1 before day 28, 2 later in hospital, 3 later at home."""
    unit_dead = unit_status.eqNullSafe(F.lit(dead))
    hospital_dead = hospital_status.eqNullSafe(F.lit(dead))
    place = F.when(unit_dead, hospital_location).otherwise(unit_location)
    days = F.when(unit_dead, unit_days).otherwise(hospital_days)
    at_home = place.eqNullSafe(F.lit(home))
    return (
        F.when(~unit_dead & ~hospital_dead, -1)
        .when(unit_dead & ~at_home, 0)
        .when(days < SHORT_STAY_DAYS, 1)
        .when(~at_home, 2)
        .otherwise(3)
    )


def discharge_category(status: Column, days: Column) -> Column:
    """Text class of a discharge by hospital status and length of stay in whole days."""
    alive, expired = status.like("%Alive%"), status.like("%Expired%")
    return (
        F.when(alive & (days > 1), "long stay")
        .when(alive & (days < 1), "spontaneous recovery")
        .when(expired & (days < 1), "icu-day Mortality")
        .otherwise("hospital Mortality")
    )
