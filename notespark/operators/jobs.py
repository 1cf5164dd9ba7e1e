"""Queue and job state machine, over tables; streaming/fsm.py runs the same rules over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_RETRIES = 3
# The steps that may follow each step.
FORWARD = {
    "queued": ("parsing",), "parsing": ("parsed", "failed"), "parsed": ("storing", "failed"), "storing": ("stored", "failed"), "stored": ("summarizing", "failed"),
    "summarizing": ("summarized", "failed"), "summarized": ("embedding", "failed"), "embedding": ("embedded", "failed"),
}
TERMINAL = ("embedded", "dead_letter")


def transitions(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in FORWARD.items() for b in bs], "from_step string, to_step string")


def enqueue(queue: DataFrame, items: DataFrame) -> DataFrame:
    """queue plus items(id, queue_name, payload): pending, never tried."""
    now = F.current_timestamp()
    fresh = items.select("id", "queue_name", "payload", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("error_message"), now.alias("enqueued_at"), now.alias("updated_at"))
    return queue.unionByName(fresh)


def dequeue(queue: DataFrame, name: str, batch: int, concurrency: int = 1, processing: int = 0) -> DataFrame:
    """The oldest pending items, as many as there are free places."""
    free = max(0, min(batch, concurrency - processing))
    return queue.filter((F.col("queue_name") == name) & (F.col("status") == "pending")).orderBy("enqueued_at", "id").limit(free)


def with_status(queue: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """queue with ids(id) moved to a status: processing when dequeued, completed when acknowledged."""
    marked = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return queue.join(marked, "id", "left").withColumn("status", F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status"))).select(*queue.columns)


def nack(queue: DataFrame, failed: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """queue after failures(id, error): tried again, or dead after more than `most` retries."""
    marked = failed.select("id", F.col("error").alias("__error")).withColumn("__hit", F.lit(True))
    n = F.col("retry_count") + F.when(F.col("__hit"), 1).otherwise(0)
    out = queue.join(marked, "id", "left").withColumn("retry_count", n.cast("int"))
    status = F.when(F.col("__hit"), F.when(F.col("retry_count") > most, "dead_letter").otherwise("pending")).otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("error_message", F.coalesce("__error", "error_message")).select(*queue.columns)


def reclaim(queue: DataFrame) -> DataFrame:
    """At a start, what was being processed is pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def status(queue: DataFrame, jobs: DataFrame, name: str) -> DataFrame:
    """One row: the four status counts of a queue, failed and dead jobs, and dead items and jobs together."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("long")
    q = queue.filter(F.col("queue_name") == name).agg(n("pending").alias("pending"), n("processing").alias("processing"), n("completed").alias("completed"), n("dead_letter").alias("dead_items"))
    j = jobs.agg(F.count_if(F.col("current_step") == "failed").alias("failed_jobs"), F.count_if(F.col("current_step") == "dead_letter").alias("dead_jobs"))
    return q.crossJoin(j).withColumn("dead_letter", F.col("dead_items") + F.col("dead_jobs"))  # one row each


def illegal_steps(events: DataFrame, job: str = "job_id", seq: str = "seq", step: str = "step") -> DataFrame:
    """Events (job, seq, step) that may not follow the one before: repeats of a step are no change."""
    before = F.lag(step).over(Window.partitionBy(job).orderBy(seq))
    moves = events.withColumn("from_step", before).filter((F.col("from_step").isNotNull()) & (F.col("from_step") != F.col(step)))
    known = transitions(events.sparkSession)
    return moves.join(F.broadcast(known), (moves["from_step"] == known["from_step"]) & (moves[step] == known["to_step"]), "left_anti")


def recoverable(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("current_step").isin(*TERMINAL))


def without_path(jobs: DataFrame, paths: DataFrame) -> DataFrame:
    return jobs.join(paths.select(F.col("path").alias("note_path")), "note_path", "left_anti")


def ensure(step: str | None, retries: int, most: int = MAX_RETRIES) -> tuple[str, int]:
    """State of a job that is wanted again: new, retried after a failure, restarted after an interruption, or as it is."""
    if step is None:
        return "queued", 0
    if step in TERMINAL:
        return step, retries
    if step == "failed":
        return move(step, "queued", retries, most)
    return "queued", retries


def move(step: str, to: str, retries: int, most: int = MAX_RETRIES) -> tuple[str, int]:
    """One transition; the same step is no change, an illegal one an error, failing too often the end."""
    if step == to:
        return step, retries
    if step in TERMINAL:
        raise ValueError(f"{step} is final")
    if step == "failed" and to == "queued":
        return ("dead_letter" if retries + 1 > most else "queued"), retries + 1
    if to not in FORWARD.get(step, ()):
        raise ValueError(f"{step} cannot become {to}")
    return to, retries


def fail(step: str) -> str:
    """Any step fails, but a final one stays."""
    return step if step in TERMINAL else "failed"
