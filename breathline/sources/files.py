"""Text sources and sinks: CSV, labelled matrices, header scans of folders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str, sep: str = ",", missing: str = "", drop_malformed: bool = False
) -> DataFrame:
    """CSV with a header and a declared schema; a malformed line is an error unless dropping is asked for."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", missing)
    if drop_malformed:
        return _without_malformed(reader, schema, path)
    lines = reader.schema(schema).option("mode", "FAILFAST").csv(path)
    return lines.filter(_all_parsed(lines.columns))


def _all_parsed(columns: Sequence[str]) -> Column:
    """Always true, but needs every column: Spark parses only the fields that a query uses, so whether a line is
    malformed would else depend on the columns selected later."""
    return F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in columns])) >= 0


def _without_malformed(reader: DataFrameReader, schema: StructType | str, path: str | Sequence[str]) -> DataFrame:
    """Lines that fit the schema, whichever columns are selected later."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = StructType([*wanted.fields, StructField("_malformed", StringType())])
    lines = reader.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").csv(path)
    return lines.filter(F.col("_malformed").isNull() & _all_parsed(wanted.names)).select(*wanted.names)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV folder whose every part file starts with the header."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_csv_folder(spark: SparkSession, folder: str, schema: StructType | str, extension: str = "csv") -> DataFrame:
    """All files of one extension below a folder, bad lines dropped."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}")
    return _without_malformed(reader, schema, folder)


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read the first record of each file, where the task runs; a quoted name may hold line breaks."""
    import csv
    import io

    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch["path"]:
            filesystem, inner = fs.FileSystem.from_uri(path)
            with filesystem.open_input_stream(inner) as stream:
                lines = io.TextIOWrapper(io.BufferedReader(stream), "utf-8-sig", errors="replace", newline="")
                for position, name in enumerate(next(csv.reader(lines), [])):
                    out.append((path, position, name))
        yield pd.DataFrame(out, columns=["path", "position", "name"])


def header_columns(spark: SparkSession, folder: str, extension: str = "csv") -> DataFrame:
    """(path, position, name) of every header below a folder; file bodies are not read."""
    paths = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{extension}")
        .load(folder)
        .select("path")
    )
    return paths.mapInPandas(_first_lines, "path string, position int, name string")


def distinct_header_columns(spark: SparkSession, folder: str, extension: str = "csv") -> DataFrame:
    return header_columns(spark, folder, extension).select("name").distinct()


def read_labelled_matrix(
    spark: SparkSession,
    path: str,
    n_features: int,
    sep: str = r"\s+",
    missing: str = "?",
    label_at: int = -1,
) -> DataFrame:
    """Delimited numbers with a label: (x0, x1, ..., label), missing markers as NULL.

    Lines are split on white space or on the given pattern. Longer lines keep
    their first ``n_features`` fields, shorter ones cannot be rows; both kinds
    are returned whole by ``ragged_lines``. ``label_at`` counts from the end of
    the line when negative.
    """
    lines = _split_lines(spark, path, sep).filter(F.size("f") > n_features)
    number = lambda i: F.nullif(F.element_at("f", i), F.lit(missing)).try_cast("double")
    label = number(label_at if label_at < 0 else label_at + 1).cast("int")
    return lines.select(*[number(i + 1).alias(f"x{i}") for i in range(n_features)], label.alias("label"))


def _split_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.text(path).select("value", F.split(F.trim(F.col("value")), sep).alias("f"))


def ragged_lines(spark: SparkSession, path: str, n_features: int, sep: str = r"\s+") -> DataFrame:
    """(value, fields): the non-empty lines of a labelled matrix that do not have exactly ``n_features`` + 1 fields."""
    lines = _split_lines(spark, path, sep).select("value", F.size("f").alias("fields"))
    return lines.filter((F.col("fields") != n_features + 1) & (F.trim("value") != ""))


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, subset=list(columns))
