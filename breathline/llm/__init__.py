"""Operators of a training-data pipeline, and the queries that bind them to the driver's tables."""
