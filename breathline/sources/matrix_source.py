"""Labelled matrices as a Spark data source: byte ranges as partitions, the columns asked for, lines that do not fit with a reason.

    use_matrix_source(spark)
    spark.read.format("labelled_matrix").option("features", 4).load(path)
    spark.read.format("labelled_matrix").schema("x2 double, label int").option("features", 4).load(path)

Options: ``features`` (their number, wanted), ``sep`` (a pattern, white space by
default), ``missing`` (the marker read as NULL, ``?``), ``label_at`` (place of the
label, counted from the end when negative, -1), ``split_bytes`` (64 MiB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from breathline.session import ship_package

READ_BYTES = 4 << 20
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
REASONS = ("few fields", "not a number", "many fields")


@dataclass
class ByteRange(InputPartition):
    """The lines of one file that begin in [start, stop)."""

    path: str
    start: int
    stop: int


def _open(path: str):
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem, inner


def plan_ranges(path: str, split_bytes: int) -> list[ByteRange]:
    """The files at or below ``path``, hidden ones left out, cut into ranges of bytes."""
    from pyarrow import fs

    filesystem, inner = _open(path)
    inner = inner.rstrip("/")
    path = path.rstrip("/")
    before = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = filesystem.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and not any(part[:1] in ("_", ".") for part in f.path[len(inner) :].split("/"))]
    return [
        ByteRange(before + f.path, at, min(at + split_bytes, f.size))
        for f in sorted(files, key=lambda f: f.path)
        for at in range(0, f.size, split_bytes)
    ]


def lines_of(part: ByteRange) -> Iterator[pa.Array]:
    """Whole lines that begin inside the range, in runs of about ``READ_BYTES``."""
    filesystem, inner = _open(part.path)
    with filesystem.open_input_file(inner) as file:
        at = part.start
        if at:  # a line that began before belongs to the range before
            file.seek(at - 1)
            at -= 1
            while chunk := file.read(READ_BYTES):
                end = chunk.find(b"\n")
                if end >= 0:
                    at += end + 1
                    break
                at += len(chunk)
            else:
                return
        file.seek(at)
        rest = b""
        while at < part.stop:  # ``at`` is where the rest begins
            chunk = file.read(READ_BYTES)
            if not chunk:
                break
            held = rest + chunk
            last = held.rfind(b"\n") + 1
            whole, rest = held[:last], held[last:]
            # only lines that begin before the stop are ours
            over = whole.find(b"\n", max(0, part.stop - at - 1)) + 1 if at + len(whole) >= part.stop else 0
            if over:
                yield _texts(whole[:over])
                return
            if whole:
                yield _texts(whole)
            at += len(whole)
        if rest and at < part.stop:
            yield _texts(rest)


def _texts(whole: bytes) -> pa.Array:
    lines = whole.decode("utf-8", errors="replace").split("\n")
    return pa.array(lines[:-1] if lines[-1] == "" else lines, pa.string())


def parse_lines(lines: pa.Array, wanted: StructType, features: int, sep: str, missing: str, label_at: int) -> pa.RecordBatch:
    """The wanted columns of the lines; blank lines are no rows.

    ``few fields``: too short to be a row, all numbers NULL. ``not a number``: a
    field asked for is no number, it is NULL. ``many fields``: the surplus is
    left out. Such lines carry ``_reason`` and themselves in ``_line``, others NULL.
    """
    trimmed = pc.utf8_trim(lines, " \r")
    solid = pc.not_equal(pc.utf8_length(trimmed), 0)
    lines, trimmed = lines.filter(solid), trimmed.filter(solid)
    fields = pc.split_pattern_regex(trimmed, sep)
    count = pc.list_value_length(fields)
    starts, flat = fields.offsets[: len(fields)], fields.values
    long_enough = pc.greater(count, features)
    wrong = pa.array([False] * len(lines), pa.bool_())
    columns: dict[str, pa.Array] = {}
    for column in wanted.fields:
        name = column.name
        if name in ("_line", "_reason"):
            continue
        if name == "label":
            place = pc.add(starts, label_at) if label_at >= 0 else pc.add(pc.add(starts, count), label_at)
        else:
            place = pc.add(starts, int(name[1:]))
        text = flat.take(pc.if_else(long_enough, place, pa.scalar(None, place.type)))
        text = pc.if_else(pc.equal(text, missing), pa.scalar(None, pa.string()), text)
        good = pc.fill_null(pc.match_substring_regex(text, NUMBER), True)
        wrong = pc.or_(wrong, pc.invert(good))
        value = pc.cast(pc.if_else(good, text, pa.scalar(None, pa.string())), pa.float64())
        columns[name] = pc.cast(pc.trunc(value), pa.int32()) if name == "label" else value
    reason = pc.case_when(
        pc.make_struct(pc.invert(long_enough), wrong, pc.greater(count, features + 1)), *[pa.scalar(r) for r in REASONS]
    )
    columns["_reason"] = reason
    columns["_line"] = pc.if_else(pc.is_valid(reason), lines, pa.scalar(None, pa.string()))
    names = wanted.names
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str], wanted: StructType):
        self.options, self.wanted = options, wanted

    def partitions(self) -> list[ByteRange]:
        return plan_ranges(self.options["path"], int(self.options.get("split_bytes", 64 << 20)))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        o = self.options
        for lines in lines_of(partition):
            yield parse_lines(
                lines, self.wanted, int(o["features"]), o.get("sep", r"\s+"), o.get("missing", "?"), int(o.get("label_at", -1))
            )


class LabelledMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "labelled_matrix"

    def schema(self) -> StructType:
        out = StructType()
        for i in range(int(self.options["features"])):
            out.add(f"x{i}", DoubleType())
        return out.add("label", IntegerType()).add("_line", StringType()).add("_reason", StringType())

    def reader(self, schema: StructType) -> MatrixReader:
        known = {f.name: f.dataType for f in self.schema().fields}
        for f in schema.fields:
            if known.get(f.name) != f.dataType:
                raise ValueError(f"a labelled matrix has no column {f.name} {f.dataType.simpleString()}")
        return MatrixReader(dict(self.options), schema)


def use_matrix_source(spark: SparkSession) -> None:
    """Make ``spark.read.format("labelled_matrix")`` known to the session."""
    ship_package(spark)
    spark.dataSource.register(LabelledMatrix)
