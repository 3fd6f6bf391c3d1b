"""Relations over JDBC, Parquet or the catalog; key lookups; catalog listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.sources.schemas import relation_schema


def jdbc_options(
    url: str,
    table: str,
    schema: str | None = None,
    key: str = "patientunitstayid",
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    """Options of a partitioned JDBC read; credentials come in ``properties``."""
    options = {"url": url, "dbtable": f"{schema}.{table}" if schema else table, "fetchsize": "10000"}
    if bounds:
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options | (properties or {})


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Relation from a database, read in parallel by ranges of the stay id.

    Without ``bounds`` the smallest and largest id are asked from the database.
    """
    key = options.get("key", "patientunitstayid")
    if options.get("bounds") is None:
        plain = jdbc_options(url, table, **{**options, "bounds": None})
        ends = (
            spark.read.format("jdbc").options(**plain).load()
            .agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        )
        if ends.low is None:
            return spark.read.format("jdbc").options(**plain).load()
        options["bounds"] = (int(ends.low), int(ends.high) + 1)
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def range_histogram(rows: DataFrame, key: str, low: int, high: int, ranges: int = 4096) -> DataFrame:
    """(at, n): rows per range of ids of equal width in [low, high]; ids outside are not counted."""
    width = -(-(high - low + 1) // ranges)
    at = F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("bigint")
    return rows.filter(F.col(key).between(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))


def balanced_predicates(
    histogram: Sequence[tuple[int, int]], key: str, low: int, high: int, partitions: int, ranges: int = 4096, spread_by: str | None = None
) -> list[str]:
    """SQL conditions that cut a table into slices of about equal row counts.

    ``histogram`` has (at, n) of ``range_histogram``, at most ``ranges`` entries.
    Neighbouring ranges are joined until a slice is full. A range that alone holds
    several slices' worth is cut by the remainder of the integer column
    ``spread_by`` if one is given. Each row, with a NULL id too, fits exactly one
    condition; ids outside [low, high] fall into the first and last slice.
    """
    width = -(-(high - low + 1) // ranges)
    counts = dict(histogram)
    share = max(1.0, sum(counts.values()) / partitions)
    cuts: list[tuple[int, int, int]] = []  # first range, range after the last, number of pieces
    begin, held = 0, 0
    last = max(counts, default=0) + 1
    for at in sorted(counts):
        n = counts[at]
        pieces = round(n / share) if spread_by else 1
        if held and (held + n > share or pieces > 1):
            cuts.append((begin, at, 1))
            begin, held = at, 0
        held += n
        if held >= share or pieces > 1:
            cuts.append((begin, at + 1, max(1, pieces)))
            begin, held = at + 1, 0
    if held or not cuts:
        cuts.append((begin, last, 1))
    out = []
    for i, (first, stop, pieces) in enumerate(cuts):
        ends = [] if i == 0 else [f"{key} >= {low + first * width}"]
        ends += [] if i == len(cuts) - 1 else [f"{key} < {low + stop * width}"]
        inside = " AND ".join(ends) or f"{key} IS NOT NULL"
        if i == 0:
            inside = f"({inside} OR {key} IS NULL)"
        if pieces == 1:
            out.append(inside)
        else:  # NULL in the spreading column goes with remainder 0
            out += [f"{inside} AND coalesce(abs({spread_by} % {pieces}), 0) = {r}" for r in range(pieces)]
    return out


def read_jdbc_balanced(
    spark: SparkSession, url: str, table: str, schema: str | None = None, key: str = "patientunitstayid", partitions: int = 64,
    spread_by: str | None = None, ranges: int = 4096, properties: dict[str, str] | None = None,
) -> DataFrame:
    """Relation from a database in slices of equal row counts, whatever ids are hot.

    The database counts rows per range of ids; at most ``ranges`` counts reach the driver.
    """
    def asked(query: str) -> DataFrame:
        return spark.read.format("jdbc").options(**jdbc_options(url, f"({query}) q", properties=properties)).load()

    name = f"{schema}.{table}" if schema else table
    ends = asked(f"SELECT min({key}) AS low, max({key}) AS high FROM {name}").first()
    whole = jdbc_options(url, table, schema, properties=properties)
    if ends.low is None:
        return spark.read.format("jdbc").options(**whole).load()
    low, high = int(ends.low), int(ends.high)
    width = -(-(high - low + 1) // ranges)
    at = f"floor(({key} - {low}) / {float(width)})"
    counts = [(int(r[0]), int(r[1])) for r in asked(f"SELECT {at} AS id_range, count(*) AS n FROM {name} WHERE {key} IS NOT NULL GROUP BY {at}").collect()]
    parts = balanced_predicates(counts, key, low, high, partitions, ranges, spread_by)
    return spark.read.jdbc(url, whole["dbtable"], predicates=parts, properties={**(properties or {}), "fetchsize": whole["fetchsize"]})


def read_relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Clinical relation stored as Parquet under ``folder``, with its declared schema."""
    return spark.read.schema(relation_schema(name)).parquet(f"{folder}/{name}")


def save_by_key(df: DataFrame, table: str, key: str = "stay_id", buckets: int = 1024) -> None:
    """Bucketed table: joins and aggregates on the key then need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def rows_of_key(df: DataFrame, key: str, value) -> DataFrame:
    """All rows of one id; the predicate reaches the scan."""
    return df.filter(F.col(key) == value)


def rows_of_keys(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def list_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, column, type) of the tables and views of one schema of the catalog."""
    rows = [
        (t.name, c.name, c.dataType)
        for t in spark.catalog.listTables(database)
        for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{database or t.namespace[0]}.{t.name}")
    ]
    return spark.createDataFrame(rows, "table string, column string, type string")


def as_measurements(
    df: DataFrame, stay: str, time: str, name: Column, value: Column
) -> DataFrame:
    """Project any relation to the long layout (stay_id, offset_min, name, value)."""
    return df.select(
        F.col(stay).cast("bigint").alias("stay_id"),
        F.col(time).cast("int").alias("offset_min"),
        name.alias("name"),
        value.cast("double").alias("value"),
    )


def relations_from(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: read_relation(spark, folder, n) for n in names}
