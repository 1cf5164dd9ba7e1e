"""Session set-up that every entry point shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch. Long texts make Spark's default of 10,000 rows cost hundreds of MB a task.
BATCH_ROWS = "300"
#: Bytes in an Arrow batch, for the same reason.
BATCH_BYTES = 2 << 20
_made: list[tuple[SparkSession, str]] = []
ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started from (on a cluster, ship it with --py-files), and
    keeps Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; a value of one's own stays
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{64 << 20}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, which driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local
    mode only)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="notespark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in that folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark)}/notespark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


@atexit.register
def _delete_made() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before the interpreter
            return


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder: what follows reads it, also after executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
