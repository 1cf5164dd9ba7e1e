"""What the operators of this subpackage share: shared-folder tables, small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ready

_written: list[tuple[SparkSession, str, str]] = []

PART_BYTES = 32 << 20  # of input: what makes another file worth while at any size
LEAST_BYTES = 1 << 20  # of input: what makes another task worth while
TASKS_A_CORE = 2
ROW_GROUP = 16 << 20  # bytes that a writer gathers in memory
BROADCAST_ROWS = 250_000  # at most so many rows of one or two numbers are broadcast (some MB); more are joined by an exchange


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local mode only)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="notespark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str, owner: str = "") -> str:
    """A fresh path in the shared folder; it is deleted when the application ends or by release(owner)."""
    path = f"{shared_dir(spark)}/notespark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path, owner))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def few_files(df: DataFrame) -> DataFrame:
    """df in a few partitions a core, fewer where its inputs hold less than LEAST_BYTES for each, and more where they hold over
    PART_BYTES: no swarms of tiny files, which cost a file system more than what they hold. Nothing is shuffled; on large inputs the
    partitions stay as they are."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # rows from the driver have no known size
    wave = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    return df.coalesce(max(min(wave, 1 + known // LEAST_BYTES), min(known // PART_BYTES, 1_000_000)))


def write_table(df: DataFrame, name: str, owner: str = "", by: Column | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors, keeps column pruning.
    by: a number that the files are parted by, read back as __nd_part, so that a filter on it opens only its files."""
    spark = df.sparkSession
    path = new_path(spark, name, owner)
    if by is None:
        few_files(df).write.option("parquet.block.size", ROW_GROUP).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    few_files(df.withColumn("__nd_part", by.cast("int"))).write.option("parquet.block.size", ROW_GROUP).partitionBy("__nd_part").parquet(path)
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__nd_part", T.IntegerType())])).parquet(path)


def small_side(table: DataFrame, most: int = BROADCAST_ROWS, cells: Column | None = None) -> DataFrame:
    """A written table as the small side of a join: broadcast if it has at most `most` rows (or cells, where rows are of different
    sizes), else joined by an exchange, of which Spark can split the other side's hot keys, as nothing stands between this side's
    scan and its exchange."""
    size = table.count() if cells is None else table.agg(F.coalesce(F.sum(cells), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= most else table


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """The inner tables of one call: written to the shared folder, and deleted one by one as soon as nothing reads them any more.
    tidy: what a write has shuffled goes when it ends, not when the driver happens to collect its garbage."""

    def __init__(self, name: str, owner: str = "", tidy: bool = False):
        self.owner, self.own, self.tidy = owner or name, f"{name}-{uuid.uuid4().hex[:12]}", tidy

    def write(self, df: DataFrame, name: str, by: Column | None = None) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(TIDY, None)
        if self.tidy:
            conf.set(TIDY, "true")
        try:
            return write_table(df, name, f"{self.own}/{name}", by)
        finally:
            if self.tidy:
                conf.set(TIDY, before) if before is not None else conf.unset(TIDY)

    def drop(self, *names: str) -> None:
        for name in names:
            release(f"{self.own}/{name}")

    def close(self, *but: str) -> None:
        """Deletes all that is left, except for these."""
        for owner in {x[2] for x in _written if x[2].startswith(f"{self.own}/")} - {f"{self.own}/{n}" for n in but}:
            release(owner)

    def leave(self, *names: str) -> None:
        """These stay for the result, which is read later: they go with the operator's name, or when the application ends."""
        for i, (spark, path, owner) in enumerate(_written):
            if owner in {f"{self.own}/{n}" for n in names}:
                _written[i] = (spark, path, self.owner)


#: Bytes of row numbers that are broadcast at once, and what a chunk of CHUNK rows takes besides two bytes a row.
DROP_BYTES, CHUNK, CHUNK_BYTES = 48 << 20, 4096, 120


def place_of(docs: DataFrame) -> tuple[Column, Column] | None:
    """File and row number of each row, where docs is a scan of Parquet files."""
    try:
        at = docs.metadataColumn("_metadata")
        place = F.xxhash64(at["file_path"]), at["row_index"]
        docs.select(*place)
        return place
    except AnalysisException:
        return None


def drop_rows(docs: DataFrame, gone: DataFrame, own: Scratch, most: int = DROP_BYTES) -> DataFrame:
    """docs, a scan of Parquet files, without the rows of gone(file, row). Row numbers go as lists by chunks of a file, and are broadcast
    in groups of files of which each takes no more than `most` bytes, a file that takes more in several turns. So docs are in no exchange,
    whatever goes, and each file is read once, unless it alone has more rows that go than may be broadcast."""
    file, row = place_of(docs)
    f, c, rows = fresh(docs, "file", "chunk", "rows")
    chunk = F.floor(F.col("row") / CHUNK).cast("long")
    lists = gone.groupBy("file", chunk.alias("chunk")).agg(F.collect_set((F.col("row") % CHUNK).cast("smallint")).alias("rows"))
    lists = own.write(lists, "rows-that-go")
    own.leave("rows-that-go")
    cost = F.sum(2 * F.size("rows") + CHUNK_BYTES)
    of = -(-(lists.agg(cost).first()[0] or 0) // most) or 1
    turns = {r.k: -(-r.b // (2 * most)) for r in lists.groupBy(F.pmod("file", F.lit(of)).alias("k")).agg(cost.alias("b")).collect()}  # a row a group
    parts = []
    for k in range(of):
        part = docs.filter(F.pmod(file, F.lit(of)) == k) if of > 1 else docs
        mine = lists.filter(F.pmod("file", F.lit(of)) == k) if of > 1 else lists
        n = turns.get(k, 1)
        at = F.floor(row / CHUNK).cast("long")
        for turn in range(n):
            some = part.filter(F.pmod(at, F.lit(n)) == turn) if n > 1 else part
            listed = (mine.filter(F.pmod("chunk", F.lit(n)) == turn) if n > 1 else mine).select(F.col("file").alias(f), F.col("chunk").alias(c), F.col("rows").alias(rows))
            numbered = some.withColumns({f: file, c: at, f"{rows}_at": (row % CHUNK).cast("smallint")})
            kept = numbered.join(F.broadcast(listed), [f, c], "left").filter(~F.coalesce(F.array_contains(F.col(rows), F.col(f"{rows}_at")), F.lit(False)))
            parts.append(kept.select(*[F.col(f"`{x}`") for x in docs.columns]))
    return reduce(DataFrame.unionByName, parts)


def release(owner: str) -> None:
    """Deletes the shared tables of one owner, once nothing that reads them will run any more."""
    for item in [x for x in _written if x[2] == owner]:
        _written.remove(item)
        delete_path(item[0], item[1])


@atexit.register
def _release_all() -> None:
    for spark, path, _ in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from these that df doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__nd_{name}"
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Returns what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(run):
    """A step on Arrow batches that gives memory back when its task ends: workers stay for other tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it many times or inside lambdas."""
    return F.transform(F.array(value), body)[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
