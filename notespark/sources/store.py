"""The store: Parquet folders by table and bucket of notes, and one manifest that names the current ones.

All that hangs on a note lies in the bucket of its note: node ids start with four hex digits of the note's hash. A write makes new
folders for the buckets that it touches and copies nothing else; what a transaction has written becomes visible with one small file,
the next manifest, which names the folders of all tables. So a run that dies between two tables changes nothing, readers keep the
version that they started with for RETAIN_S after it is out of date, and of two writers that started from the same version the
second one fails.

That needs a file system that refuses to create a file twice and renames it as a whole, as HDFS and local disks do; on an object store
without those two, only one writer may run.

The keyword index is a table like the others (one row for each node and term, sorted by term, so that a filter on terms skips row
groups); the numbers that BM25 needs of the whole store are kept by bucket in the manifest. Both are updated for touched buckets only.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.search import postings

#: The column whose bucket a row lies in, and by which rows are replaced.
KEYS = {
    "nodes": "note_id", "note_meta": "note_id", "summaries": "node_id", "tags": "node_id", "embeddings": "node_id", "cross_refs": "source_node_id", "postings": "id",
    "queue_items": "id", "job_steps": "job_id", "progress_events": "job_id", "config": "key",
}
OF_NODES = ("summaries", "tags", "embeddings", "cross_refs", "postings")
RETAIN_S = 6 * 3600  # how long readers can use a version that is out of date; longer than the longest transaction
MOST_FOLDERS = 16  # of a bucket, before they are written as one
BUCKETS = 16  # of a new store; one of a billion notes wants some thousands


def bucket_of(table: str, buckets: int) -> Column:
    """The bucket of a row: that of its note, where it hangs on one."""
    key = F.col(KEYS[table])
    digits = F.substring(F.sha2(key, 256), 1, 4) if KEYS[table] == "note_id" else F.substring(key, 1, 4)
    number = F.when(digits.rlike("^[0-9a-f]{4}$"), F.conv(digits, 16, 10).cast("long")).otherwise(F.xxhash64(key))
    return F.pmod(number, F.lit(buckets)).cast("int")


class Conflict(RuntimeError):
    """Another writer has committed since this transaction began."""


class Store:
    def __init__(self, spark: SparkSession, base: str, dimension: int, buckets: int = BUCKETS, retain_s: float = RETAIN_S):
        self.spark, self.base, self.buckets, self.retain_s = spark, base.rstrip("/"), buckets, retain_s
        self._pending: dict | None = None
        stored = self.meta("embedding_dimension")
        if stored is None:
            self.set_meta({"embedding_dimension": str(dimension), "schema_version": str(schemas.SCHEMA_VERSION), "buckets": str(buckets)})
        elif int(stored) != dimension:
            raise ValueError(f"the store holds vectors of {stored} dimensions, not {dimension}")
        self.buckets = int(self.meta("buckets") or buckets)
        self.dimension = dimension
        if int(self.meta("schema_version") or 0) < schemas.SCHEMA_VERSION:  # older stores have no keyword index
            with self.transaction():
                self.rebuild_postings()
                self.set_meta({"schema_version": str(schemas.SCHEMA_VERSION)})

    # --- versions

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.base)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.base}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _manifest(self, number: int) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.base}/_manifest/{number:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _latest(self) -> tuple[int, dict]:
        numbers = [int(n[:8]) for n in self._names("_manifest") if n.endswith(".json")]
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (-1, {"tables": {}, "stats": {}})

    def _now(self) -> dict:
        return self._pending if self._pending is not None else self._latest()[1]

    @contextmanager
    def transaction(self):
        """What is written inside becomes visible at its end, all at once; inside it is visible at once. Inner ones join the outer."""
        if self._pending is not None:
            yield
            return
        began, self._pending = self._latest()
        try:
            yield
            self._commit(began)
        finally:
            self._pending = None

    def _commit(self, began: int) -> None:
        fs, path = self._fs()
        names = self._names("_manifest")
        if [n for n in names if n.endswith(".json") and int(n[:8]) > began]:
            raise Conflict(f"version {began} is no longer the latest")
        number = max([began, *(int(n[:8]) for n in names)]) + 1
        fs.create(path(f"{self.base}/_manifest/{number:08d}.claim"), False).close()  # fails if another writer was faster
        out = fs.create(path(f"{self.base}/_manifest/{number:08d}.part"), True)
        out.write(json.dumps(self._pending).encode())
        out.close()
        if not fs.rename(path(f"{self.base}/_manifest/{number:08d}.part"), path(f"{self.base}/_manifest/{number:08d}.json")):
            raise Conflict(f"version {number} could not be published")
        self._clean(number)

    def _clean(self, number: int) -> None:
        """Deletes versions that have been out of date for RETAIN_S, and the folders that only they refer to."""
        fs, path = self._fs()
        files = {f.getPath().getName(): f.getModificationTime() / 1000 for f in fs.listStatus(path(f"{self.base}/_manifest"))}
        numbers = sorted(int(n[:8]) for n in files if n.endswith(".json"))
        # a version went out of date when the next one came
        old = [n for n, after in zip(numbers, numbers[1:]) if time.time() - files[f"{after:08d}.json"] > self.retain_s]
        if not old:
            return
        used = {f.split("/__b=")[0] for n in numbers if n not in old for t in self._manifest(n)["tables"].values() for folders in t.values() for f in folders}
        for name in files:
            if int(name[:8]) in old or (int(name[:8]) < old[-1] and not name.endswith(".json")):
                fs.delete(path(f"{self.base}/_manifest/{name}"), False)
        for table in schemas.TABLES:
            for f in fs.listStatus(path(f"{self.base}/{table}")) if fs.exists(path(f"{self.base}/{table}")) else []:
                if f"{table}/{f.getPath().getName()}" not in used and time.time() - f.getModificationTime() / 1000 > self.retain_s:  # a younger one may be a writer's
                    fs.delete(f.getPath(), True)

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """The current version, or some of its buckets; columns that a version lacks are null."""
        at = [f"{self.base}/{f}" for b, fs in sorted(self._now()["tables"].get(table, {}).items()) if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(schemas.TABLES[table]).parquet(*at) if at else self.spark.createDataFrame([], schemas.TABLES[table])

    # --- writes

    def _write(self, table: str, rows: DataFrame, version: str) -> None:
        want = self.spark.createDataFrame([], schemas.TABLES[table]).schema
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want]).withColumn("__b", bucket_of(table, self.buckets))
        # by bucket, but as many tasks and files as the rows are worth: large buckets are split, small ones share a task
        out = out.hint("rebalance", "__b")
        if table == "postings":
            out = out.sortWithinPartitions("__b", "term")
        out.write.mode("append").partitionBy("__b").parquet(f"{self.base}/{table}/{version}")

    def _folders(self, table: str, version: str) -> dict[str, str]:
        return {n[4:]: f"{table}/{version}/{n}" for n in self._names(f"{table}/{version}") if n.startswith("__b=")}

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows; what is there stays where it is."""
        with self.transaction():
            version = uuid.uuid4().hex
            self._write(table, rows, version)
            have = self._pending["tables"].setdefault(table, {})
            for b, folder in self._folders(table, version).items():
                have[b] = [*have.get(b, []), folder]
            many = {int(b) for b, folders in have.items() if len(folders) > MOST_FOLDERS}
            if many:
                whole = uuid.uuid4().hex
                self._write(table, self.read(table, many), whole)
                have |= {b: [folder] for b, folder in self._folders(table, whole).items()}

    def replace(self, table: str, rows: DataFrame | None = None, gone: DataFrame | None = None, keys: list[str] | None = None) -> None:
        """Rows whose key column is in `gone`(that column), or whose `keys` equal those of new rows, go; `rows` come in. New rows are
        computed once; only buckets with rows that come or go are written."""
        key = KEYS[table]
        with self.transaction():
            version, touched, fresh = uuid.uuid4().hex, set(), None
            if rows is not None:
                self._write(table, rows, version)
                touched |= {int(b) for b in self._folders(table, version)}
                if keys and touched:  # the files are listed here, so that what is appended below is not among them
                    fresh = self.spark.read.parquet(*[f"{self.base}/{f}" for f in self._folders(table, version).values()]).select(*keys).distinct()
            if gone is not None:
                touched |= {r.b for r in gone.select(bucket_of(table, self.buckets).alias("b")).distinct().collect()}  # one row a bucket
            have = self._pending["tables"].setdefault(table, {})
            if any(str(b) in have for b in touched):
                kept = self.read(table, touched)
                if gone is not None:
                    kept = kept.join(gone.select(key).distinct(), key, "left_anti")
                if fresh is not None:
                    kept = kept.join(fresh, keys, "left_anti")
                self._write(table, kept, version)
            made = self._folders(table, version)
            for b in map(str, touched):
                have.pop(b, None)
                if b in made:
                    have[b] = [made[b]]
            if table == "postings":
                self._count(touched)

    def _count(self, touched: set[int]) -> None:
        """Nodes with terms and their terms in each touched bucket."""
        stats = self._pending["stats"]
        for b in touched:
            stats.pop(str(b), None)
        rows = self.read("postings", touched).withColumn("b", bucket_of("postings", self.buckets)).groupBy("b", "id").agg(F.max("length").alias("n")).groupBy("b").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
        stats |= {str(r.b): [r.docs, r.total] for r in rows.collect()}  # one row a bucket

    # --- config

    def meta(self, key: str) -> str | None:
        row = self.read("config").filter(F.col("key") == key).first()
        return row.value if row else None

    def set_meta(self, values: dict[str, str]) -> None:
        self.replace("config", self.spark.createDataFrame(list(values.items()), schemas.CONFIG), keys=["key"])

    # --- keyed writes

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those of equal keys."""
        self.replace(table, rows, keys=keys)

    def _nodes_of(self, notes: DataFrame) -> DataFrame:
        buckets = {r.b for r in notes.select(bucket_of("nodes", self.buckets).alias("b")).distinct().collect()}  # one row a bucket
        return self.read("nodes", buckets).join(notes.select("note_id").distinct(), "note_id", "left_semi").select("id")

    def replace_notes(self, nodes: DataFrame, tags: DataFrame, refs: DataFrame) -> None:
        """For each note in nodes: all its nodes, tags, links and keywords are replaced; what hung on nodes that went, goes."""
        with self.transaction():
            notes = nodes.select("note_id").distinct()
            old = self._nodes_of(notes)
            gone = old.join(nodes.select("id"), "id", "left_anti")
            self.replace("tags", tags, old.select(F.col("id").alias("node_id")))
            self.replace("cross_refs", refs, old.select(F.col("id").alias("source_node_id")))
            self.replace("postings", postings(nodes), old)
            for table in ("summaries", "embeddings"):
                self.replace(table, gone=gone.select(F.col("id").alias("node_id")))
            self.replace("nodes", nodes, notes)

    def delete_notes(self, notes: DataFrame) -> None:
        """notes(note_id) with all that hangs on them, vectors too."""
        with self.transaction():
            ids = self._nodes_of(notes)
            for table in OF_NODES:
                self.replace(table, gone=ids.select(F.col("id").alias(KEYS[table])))
            for table in ("note_meta", "nodes"):
                self.replace(table, gone=notes.select("note_id"))

    def upsert_summaries(self, rows: DataFrame) -> None:
        self.upsert("summaries", rows, ["node_id"])

    def upsert_embeddings(self, rows: DataFrame) -> None:
        ok = F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("vector length "), F.size("embedding"))))
        self.upsert("embeddings", rows.withColumn("embedding", ok), ["node_id", "vector_type"])

    def upsert_note_meta(self, rows: DataFrame) -> None:
        self.upsert("note_meta", rows, ["note_id"])

    def rebuild_postings(self) -> None:
        """The keyword index of all nodes anew."""
        with self.transaction():
            self._pending["tables"].pop("postings", None)
            self._pending["stats"] = {}
            self.replace("postings", postings(self.read("nodes")))

    # --- reads

    def nodes_by_id(self, ids: DataFrame) -> DataFrame:
        return self.read("nodes").join(ids.select("id"), "id", "left_semi")

    def nodes_by_note(self, note_id: str) -> DataFrame:
        return self.read("nodes").filter(F.col("note_id") == note_id).orderBy("depth", "sibling_order")

    def summaries_of(self, node_ids: list[str]) -> DataFrame:
        return self.read("summaries").filter(F.col("node_id").isin(node_ids))

    def embeddings_of(self, node_ids: list[str], kind: str | None = None) -> DataFrame:
        found = self.read("embeddings").filter(F.col("node_id").isin(node_ids))
        return found.filter(F.col("vector_type") == kind) if kind else found

    def with_meta(self) -> DataFrame:
        """Nodes with path and date of their note; nodes of notes without metadata are left out."""
        return self.read("nodes").join(self.read("note_meta").select("note_id", "vault_path", "note_date"), "note_id")

    def stats(self) -> DataFrame:
        """One row: number of nodes with terms and their mean length."""
        counts = list(self._now()["stats"].values())
        docs, total = sum(c[0] for c in counts), sum(c[1] for c in counts)
        return self.spark.createDataFrame([(docs, total / docs if docs else None)], "docs long, avg_length double")
