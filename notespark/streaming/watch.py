"""A folder as a stream of changes: added, changed, deleted and renamed notes, found by a new listing at each trigger.

A stream of files has new files only. Here the source is a clock, one row a trigger; each batch lists the folder (names, times and
sizes, no contents), compares the list with the one the batch before has written beside the checkpoint, and passes the differences on:
files that came or changed are read, files that went are tombstones. The list of batch n is written under n, so a batch that runs again
after a failure compares with the same list and passes on the same changes.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..session import ready
from ..sources.vault import relative_path

LISTED = "path string, modified timestamp, length long"


class _Ticks(DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(end["ms"])]

    def read(self, partition):
        yield (partition.value,)


class Ticks(DataSource):
    """One row for each trigger: the time."""

    @classmethod
    def name(cls) -> str:
        return "notes_ticks"

    def schema(self) -> str:
        return "ms long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Ticks()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of the notes that are there; contents are not read."""
    return _files(spark, folder).select(relative_path(F.col("path"), folder).alias("path"), F.col("modificationTime").alias("modified"), "length")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, modified): added, changed or deleted, by path, time and size."""
    was = old.select("path", F.col("modified").alias("m0"), F.col("length").alias("l0"))
    both = new.join(was, "path", "full")
    kind = F.when(F.col("m0").isNull(), "added").when(F.col("modified").isNull(), "deleted").when((F.col("modified") != F.col("m0")) | (F.col("length") != F.col("l0")), "changed")
    return both.select("path", kind.alias("change"), "modified").filter("change IS NOT NULL")


def read_changed(spark: SparkSession, folder: str, changed: DataFrame) -> DataFrame:
    """(path, content, hash) of the files that came or changed. Files that are older than all of them are not opened."""
    first = changed.agg(F.min("modified")).first()[0]
    files = _files(spark, folder).filter(F.col("modificationTime") >= F.lit(first)).select(relative_path(F.col("path"), folder).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return files.join(changed.select("path"), "path", "left_semi").withColumn("hash", F.sha2("content", 256))


def renamed(came: DataFrame, went: DataFrame) -> DataFrame:
    """(old_path, path): files that came with the contents of one that went, by came(path, hash) and went(path, hash)."""
    gone = went.groupBy("hash").agg(F.min("path").alias("old_path"))
    return came.join(gone, "hash").groupBy("old_path").agg(F.min("path").alias("path"))


def start(spark: SparkSession, folder: str, engine, checkpoint: str, once: bool = True, every: str = "15 seconds", told=None) -> StreamingQuery:
    """Indexes what changes in the folder and deletes what goes. told(changes): called with each batch's changes (path, change, old_path),
    old_path being set where a file was renamed."""
    spark = ready(spark)
    spark.dataSource.register(Ticks)

    def lists(batch: int) -> str:
        return f"{checkpoint}/listings/{batch}"

    def there(path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def batch(_: DataFrame, number: int) -> None:
        if not there(lists(number)):
            listing(spark, folder).write.mode("overwrite").parquet(lists(number))
        new = spark.read.schema(LISTED).parquet(lists(number))
        old = spark.read.schema(LISTED).parquet(lists(number - 1)) if number else spark.createDataFrame([], LISTED)
        found = changes(old, new)
        went, came = found.filter("change = 'deleted'"), found.filter("change <> 'deleted'")
        if found.isEmpty():
            return
        files = spark.createDataFrame([], "path string, content string, hash string") if came.isEmpty() else read_changed(spark, folder, came)
        if told:
            stored = engine.store.read("note_meta").select(F.col("note_id").alias("path"), F.col("content_hash").alias("hash"))
            moves = renamed(files.join(came.filter("change = 'added'").select("path"), "path", "left_semi"), stored.join(went.select("path"), "path", "left_semi"))
            told(found.select("path", "change").join(moves, "path", "left"))
        engine.index(files, deleted=went.select("path"))

    writer = spark.readStream.format("notes_ticks").load().writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/query")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
