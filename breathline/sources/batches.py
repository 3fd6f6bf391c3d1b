"""CSV appends that can be repeated: staged files, and a manifest per batch id that alone makes them visible.

    append_batch(df, path, "2024-05-01")   # again after a crash, or twice: the batch is there once
    read_batches(spark, path, schema)

Tasks write files of their own under ``path/data``. When all tasks are done the
driver lists the files in ``path/manifests/<batch>.json``, moved into place whole.
Readers see listed files only, so what lost, repeated or speculative tasks left
behind is never read. If the manifest is there already, the new files go.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from breathline.session import ship_package
from breathline.sources.files import read_csv


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        self.path, self.batch = path.rstrip("/"), batch

    def _fs(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        filesystem, top = self._fs()
        folder, name, rows, writer = f"{top}/data", f"{self.batch}-{uuid.uuid4().hex}.csv", 0, None
        filesystem.create_dir(folder, recursive=True)
        with filesystem.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                writer = writer or csv.CSVWriter(out, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer:
                writer.close()
        if not rows:
            filesystem.delete_file(f"{folder}/{name}")
        return Staged(name if rows else "", rows)

    def commit(self, messages: list[Staged | None]) -> None:
        filesystem, top = self._fs()
        staged = [m for m in messages if m and m.file]
        manifest = f"{top}/manifests/{self.batch}.json"
        if filesystem.get_file_info(manifest).type != fs.FileType.NotFound:
            return self.abort(messages)
        filesystem.create_dir(f"{top}/manifests", recursive=True)
        draft = f"{top}/manifests/_{self.batch}-{uuid.uuid4().hex}"
        with filesystem.open_output_stream(draft) as out:
            out.write(json.dumps({"files": sorted(m.file for m in staged), "rows": sum(m.rows for m in staged)}).encode())
        filesystem.move(draft, manifest)

    def abort(self, messages: list[Staged | None]) -> None:
        filesystem, top = self._fs()
        for m in messages:
            if m and m.file:
                filesystem.delete_file(f"{top}/data/{m.file}")


class CsvBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_batches"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are only appended")
        return BatchWriter(self.options["path"], self.options["batch"])


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Add the rows as one batch, all or none; a batch that is there already is left as it is."""
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(CsvBatches)
    df.write.format("csv_batches").mode("append").option("path", path).option("batch", batch).save()


def manifests(path: str) -> dict[str, dict]:
    """batch id -> {files, rows} of all batches that are whole."""
    filesystem, top = fs.FileSystem.from_uri(path.rstrip("/"))
    found = {}
    for f in filesystem.get_file_info(fs.FileSelector(f"{top}/manifests", allow_not_found=True)):
        if f.base_name.endswith(".json") and not f.base_name.startswith("_"):
            with filesystem.open_input_stream(f.path) as held:
                found[f.base_name.removesuffix(".json")] = json.loads(held.read())
    return found


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all whole batches."""
    files = sorted(f"{path.rstrip('/')}/data/{name}" for m in manifests(path).values() for name in m["files"])
    if not files:
        return spark.createDataFrame([], schema)
    return read_csv(spark, files, schema)


def drop_leftovers(path: str) -> int:
    """Delete staged files that no manifest lists; only while nothing is being appended. Returns how many."""
    filesystem, top = fs.FileSystem.from_uri(path.rstrip("/"))
    listed = {name for m in manifests(path).values() for name in m["files"]}
    left = [f.path for f in filesystem.get_file_info(fs.FileSelector(f"{top}/data", allow_not_found=True)) if f.base_name not in listed]
    for name in left:
        filesystem.delete_file(name)
    return len(left)
