"""Operators bound to the driver's tables, each with the SQL that states its result."""

from breathline.catalog import cohorts, evaluation, ingestion, learners, preparation, relational, study, timeseries

MODULES = (timeseries, cohorts, relational, preparation, evaluation, learners, study, ingestion)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
