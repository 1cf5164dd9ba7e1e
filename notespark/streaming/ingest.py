"""Notes as a stream: new and changed files are planned, parsed, stored and embedded batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.vault import relative_path


def file_stream(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """(path, content, hash, modified) of Markdown files as they come, paths relative to the folder as vault.list_files() has them; at
    most `most` a batch."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).load(folder)
    path = relative_path(F.col("_metadata.file_path"), folder)
    return rows.select(path.alias("path"), F.col("value").alias("content"), F.sha2("value", 256).alias("hash"), F.col("_metadata.file_modification_time").alias("modified"))


def newest(rows: DataFrame) -> DataFrame:
    """One version of each note: the one modified last; of equal times the one of the largest hash."""
    best = F.max_by(F.struct("content", "hash"), F.struct("modified", "hash"))
    return rows.groupBy("path").agg(best.alias("v")).select("path", "v.content", "v.hash")


def start(stream: DataFrame, engine, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Indexes each batch; a batch that is run again after a failure finds its notes unchanged and does nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        engine.index(newest(rows))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="15 seconds")).start()


def progress_windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts of progress events (job_id, step, status, at) by time window; late ones within the watermark count, repeated ones once."""
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "step", "status"])
    return once.groupBy(F.window("at", size), "step", "status").agg(F.count(F.lit(1)).alias("n"))


def run_sessions(events: DataFrame, late: str = "10 minutes", gap: str = "15 minutes") -> DataFrame:
    """Each run's spells of work: (run_id, window, events, jobs, about, and dead letters), a spell ending after `gap` without an event."""
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "step", "status"])
    spells = once.groupBy(F.session_window("at", gap), "run_id")
    return spells.agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("job_id").alias("jobs"), F.count_if(F.col("status") == "dead_letter").alias("dead")).withColumnRenamed("session_window", "window")
