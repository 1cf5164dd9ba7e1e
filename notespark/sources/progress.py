"""Progress events as a Python data source: written in batches that show whole or not at all, read as a stream by any number of readers.

    events.write.format("notes_progress").option("path", folder).mode("append").save()
    spark.readStream.format("notes_progress").option("path", folder).load()

Each task writes one file and tells its name in its commit message; the driver then writes a small list of them under the next number.
Readers follow the numbers, so a reader sees each event once, whatever became of tasks that were tried twice. The folder is given as a
URI and must be one that all machines see; it is reached by pyarrow's file systems (file, hdfs, s3).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import PROGRESS
from ..session import ready

_COLUMNS = [c.strip().split(" ")[0] for c in PROGRESS.split(",")]
_SCHEMA = pa.schema([(c, pa.timestamp("us", "UTC") if c == "at" else pa.string()) for c in _COLUMNS])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return found, path.rstrip("/")


def _lists(uri: str) -> list[str]:
    """The lists there are, in order of their numbers."""
    files, at = _open(uri)
    found = files.get_file_info(fs.FileSelector(f"{at}/lists", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".json"))


def _names(uri: str, which: str) -> list[str]:
    files, _ = _open(uri)
    with files.open_input_stream(which) as f:
        return json.loads(f.read())


def _rows(uri: str, name: str) -> Iterator[pa.RecordBatch]:
    files, at = _open(uri)
    yield from pq.read_table(f"{at}/events/{name}", filesystem=files, schema=_SCHEMA).to_batches()


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator) -> _Written:
        rows = [[r[c] for c in _COLUMNS] for r in iterator]
        if not rows:
            return _Written(None)
        files, at = _open(self.uri)
        files.create_dir(f"{at}/events")
        name = f"{uuid.uuid4().hex}.parquet"
        table = pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
        pq.write_table(table, f"{at}/events/{name}", filesystem=files)
        return _Written(name)

    def commit(self, messages) -> None:
        files, at = _open(self.uri)
        files.create_dir(f"{at}/lists")
        number = len(_lists(self.uri))
        part = f"{at}/lists/{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as f:
            f.write(json.dumps([m.name for m in messages if m and m.name]).encode())
        files.move(part, f"{at}/lists/{number:012d}.json")

    def abort(self, messages) -> None:
        files, at = _open(self.uri)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{at}/events/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self):
        return [InputPartition(n) for which in _lists(self.uri) for n in _names(self.uri, which)] or [InputPartition(None)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.value:
            yield from _rows(self.uri, partition.value)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        return {"lists": len(_lists(self.uri))}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(n) for which in _lists(self.uri)[start["lists"] : end["lists"]] for n in _names(self.uri, which)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.uri, partition.value)


class Progress(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "notes_progress"

    def schema(self) -> str:
        return PROGRESS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("progress events are only appended")
        return _Writer(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    ready(spark).dataSource.register(Progress)


def sink(folder: str):
    """A progress sink for the engine: appends what it is told to the folder."""

    def tell(events: DataFrame) -> None:
        register(events.sparkSession)
        events.select(*_COLUMNS).coalesce(1).write.format("notes_progress").option("path", folder).mode("append").save()

    return tell
