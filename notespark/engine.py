"""The engine: index notes into a store, search them, chat over them."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ports, schemas
from .functions.dates import note_date
from .functions.globs import path_matches
from .operators import blockmax, indexing, jobs, search
from .operators.cells import CellIndex
from .plans import agent, chat
from .session import ready
from .sources import markdown
from .sources.store import BUCKETS, Conflict, Store

QUEUE = "index"
MAX_POISON = 20  # notes that may fail in one batch before the batch itself is taken for broken
WAVE = 1_000_000  # notes that are processed at once
GONE = "the files of its run are gone"
STEPS = ("parsing", "parsed", "storing", "stored", "summarizing", "summarized", "embedding", "embedded")


class Engine:
    def __init__(
        self, spark: SparkSession, base: str, embedder=None, summarizer=None, model=None, planner=None, daily_globs: list[str] | None = None, date_pattern: str = "YYYY-MM-DD", max_retries: int = jobs.MAX_RETRIES,
        buckets: int = BUCKETS, wave: int = WAVE, sinks: tuple = (),
    ):
        """sinks: functions that are told of each step of a batch with its progress events, a DataFrame; what they raise is only warned of."""
        self.spark, self.started = ready(spark), time.time()
        self.embedder, self.summarizer = embedder or ports.HashEmbedder(), summarizer or ports.LeadSummarizer()
        self.model, self.planner, self.max_retries = model or ports.EchoChat(), planner, max_retries
        self.store = Store(spark, base, self.embedder.dimension, buckets)
        self.daily_globs, self.date_pattern, self.wave, self.sinks = daily_globs or [], date_pattern, wave, sinks
        self._reclaim()

    def _reclaim(self) -> None:
        """What a run that died was processing waits again, and its jobs are queued again."""
        with self.store.transaction():
            queue = self.store.read("queue_items").filter("status = 'processing'")
            if queue.isEmpty():
                return
            broken = jobs.recoverable(self.store.read("job_steps")).filter("current_step <> 'failed'").withColumn("current_step", F.lit(jobs.ensure("parsing", 0)[0]))
            self.store.replace("job_steps", broken.join(queue.select(F.col("id").alias("job_id")), "job_id", "left_semi"), keys=["job_id"])
            self.store.replace("queue_items", jobs.reclaim(queue), keys=["id"])

    # --- indexing

    def index(self, files: DataFrame, deleted: DataFrame | None = None, force: bool = False, prune: bool = False) -> dict:
        """files(path, content, hash): deletes, skips, and indexes what is left by way of the queue, after what an earlier run has left
        there; returns the counts of the run, with `dead`, the notes that failed too often, where there are any."""
        self.resume()
        run = uuid.uuid4().hex
        scratch = f"{self.store.base}/_run/{run}"
        # the plan is of the store as it is now, so it is written before anything changes
        indexing.plan(files, self.store.read("note_meta"), deleted, force, prune).write.parquet(f"{scratch}/plan")
        planned = self.spark.read.parquet(f"{scratch}/plan")
        counts = indexing.run_counts(planned).first().asDict()
        if counts["enqueued"]:
            indexing.jobs(files, planned, run).write.parquet(f"{scratch}/jobs")
            todo = self.spark.read.parquet(f"{scratch}/jobs")
            with self.store.transaction():
                payload = F.to_json(F.struct(F.col("note_id").alias("path"), F.col("content_hash").alias("hash")))
                items = todo.select(F.col("job_id").alias("id"), F.lit(QUEUE).alias("queue_name"), payload.alias("payload"))
                empty = self.spark.createDataFrame([], schemas.QUEUE)
                self.store.append("queue_items", jobs.enqueue(empty, items))
                self.store.append("job_steps", self._steps(todo, F.lit("queued"), F.lit(0), F.lit(None)))
            if dead := self._drain(todo, scratch):
                counts["dead"] = dead
        self._end(planned, scratch)
        return {"run_id": run, **counts}

    def _end(self, planned: DataFrame, scratch: str) -> None:
        """Deletes the notes that the plan deletes, and the files of the run."""
        gone = planned.filter("action = 'deleted'").select(F.col("path").alias("note_id"))
        if not gone.isEmpty():
            self.store.delete_notes(gone)
        fs, path = self.store._fs()
        fs.delete(path(scratch), True)

    def resume(self) -> int:
        """Ends the runs that died: their jobs are processed from the files they had written, and what they had planned to delete is
        deleted. Jobs whose files are gone are dead letters. Returns how many jobs were waiting."""
        self._reclaim()
        fs, path = self.store._fs()
        waiting = 0
        for run in self.store._names("_run"):
            scratch = f"{self.store.base}/_run/{run}"
            if fs.exists(path(f"{scratch}/jobs/_SUCCESS")):
                todo = self.spark.read.parquet(f"{scratch}/jobs")
                if left := self._queue(todo).filter("status = 'pending'").count():
                    waiting += left
                    self._drain(todo, scratch)
            if fs.exists(path(f"{scratch}/plan/_SUCCESS")):
                self._end(self.spark.read.parquet(f"{scratch}/plan"), scratch)
            else:
                fs.delete(path(scratch), True)
        lost = self.store.read("queue_items").filter((F.col("queue_name") == QUEUE) & (F.col("status") == "pending"))
        if n := lost.count():
            waiting += n
            with self.store.transaction():
                dead = jobs.nack(lost, lost.select("id", F.lit(GONE).alias("error")), most=-1)
                steps = self.store.read("job_steps").join(lost.select(F.col("id").alias("job_id")), "job_id", "left_semi")
                self.store.replace("job_steps", steps.withColumns({"current_step": F.lit("dead_letter"), "error_message": F.lit(GONE)}), keys=["job_id"])
                self.store.replace("queue_items", dead, keys=["id"])
        return waiting

    def _queue(self, todo: DataFrame) -> DataFrame:
        """The queue's items of these jobs."""
        return self.store.read("queue_items").join(todo.select(F.col("job_id").alias("id")), "id", "left_semi")

    @staticmethod
    def _steps(todo: DataFrame, step: Column, retries: Column, error: Column) -> DataFrame:
        return todo.select("job_id", F.col("note_id").alias("note_path"), step.alias("current_step"), "content_hash", retries.cast("int").alias("retry_count"), error.cast("string").alias("error_message"), F.current_timestamp().alias("updated_at"))

    def _drain(self, todo: DataFrame, scratch: str) -> int:
        """Runs the jobs of this run, WAVE at a time, until none is pending; a job that fails is tried again up to max_retries times.
        Returns how many have failed for good."""
        while True:
            at = f"{scratch}/{uuid.uuid4().hex[:12]}"
            jobs.dequeue(self._queue(todo), QUEUE, self.wave, self.wave).select("id").write.parquet(at)
            ids = self.spark.read.parquet(at)
            wave = todo.join(ids.select(F.col("id").alias("job_id")), "job_id", "left_semi")
            if wave.isEmpty():
                return self._queue(todo).filter("status = 'dead_letter'").count()
            taken = self._queue(wave)
            with self.store.transaction():
                self.store.replace("job_steps", self._steps(wave.join(taken.select(F.col("id").alias("job_id"), "retry_count"), "job_id"), F.lit("parsing"), F.col("retry_count"), F.lit(None)), keys=["job_id"])
                self.store.replace("queue_items", self._now(jobs.with_status(taken, ids, "processing")), keys=["id"])
            failed: list[tuple[DataFrame, str]] = []
            done = self._attempt(wave, scratch, failed)
            with self.store.transaction():
                for rows, times in done:
                    items = jobs.with_status(self._queue(rows), rows.select(F.col("job_id").alias("id")), "completed")
                    self._settle(rows, items, "embedded")
                    self.store.append("progress_events", self._events(rows, times))
                for rows, error in failed:
                    items = jobs.nack(self._queue(rows), rows.select(F.col("job_id").alias("id"), F.lit(error).alias("error")), self.max_retries)
                    self._settle(rows, items, "queued")
                    self.store.append("progress_events", self._events(rows, [("failed", time.time())], error, items))
            for rows, error in failed:
                self._tell(rows, "failed", error)

    @staticmethod
    def _now(items: DataFrame) -> DataFrame:
        return items.withColumn("updated_at", F.current_timestamp())

    def _settle(self, rows: DataFrame, items: DataFrame, step: str) -> None:
        """Stores the items of jobs that have ended or failed, and the state that follows."""
        state = F.when(F.col("status") == "dead_letter", "dead_letter").otherwise(step)
        told = rows.join(items.select(F.col("id").alias("job_id"), "status", "retry_count", "error_message"), "job_id")
        self.store.replace("job_steps", self._steps(told, state, F.col("retry_count"), F.col("error_message")), keys=["job_id"])
        self.store.replace("queue_items", self._now(items), keys=["id"])

    @staticmethod
    def _events(rows: DataFrame, times: list[tuple[str, float]], error: str | None = None, items: DataFrame | None = None) -> DataFrame:
        """Progress events of jobs: a row for each job and (step, time), with the status of the job's item: processing until the last
        step, completed then, and after a failure what `items` say."""
        failed = F.lit("failed")
        if items is not None:
            rows, failed = rows.join(items.select(F.col("id").alias("job_id"), F.col("status").alias("__status")), "job_id"), F.col("__status")
        status = lambda step: failed if error else F.lit("completed" if step == "embedded" else "processing")
        steps = F.array(*[F.struct(F.lit(step).alias("step"), status(step).alias("status"), F.lit(error).cast("string").alias("detail"), F.timestamp_seconds(F.lit(at)).alias("at")) for step, at in times])
        return rows.select("job_id", "run_id", F.col("note_id").alias("note_path"), F.inline(steps))

    def _tell(self, rows: DataFrame, step: str, error: str | None = None) -> tuple[str, float]:
        """Tells all sinks of a step; none can stop the run or the others."""
        at = time.time()
        for sink in self.sinks:
            try:
                sink(self._events(rows, [(step, at)], error))
            except Exception as e:
                warnings.warn(f"a progress sink failed: {e}", stacklevel=2)
        return step, at

    def _attempt(self, todo: DataFrame, scratch: str, failed: list, depth: int = 0) -> list[tuple[DataFrame, list]]:
        """Processes todo as a whole. If that fails, halves of it, down to the notes that fail; returns what went through, with the times
        of its steps. What a failed attempt has written is never committed."""
        try:
            times: list[tuple[str, float]] = []
            with self.store.transaction():
                self._process(todo, f"{scratch}/{uuid.uuid4().hex[:12]}", lambda step: times.append(self._tell(todo, step)))
            times.append(self._tell(todo, "embedded"))
            return [(todo, times)]
        except Conflict:
            raise
        except Exception as e:
            if todo.count() == 1:
                failed.append((todo, str(e).strip().split("\n")[-1][:500]))
                if len(failed) > MAX_POISON:
                    raise
                return []
            bit = F.shiftright(F.xxhash64("job_id"), depth).bitwiseAND(F.lit(1))
            parts = [p for p in (todo.filter(bit == b) for b in (0, 1)) if not p.isEmpty()]
            if depth > 60:
                raise
        return [x for p in parts for x in self._attempt(p, scratch, failed, depth + 1)]

    def _process(self, todo: DataFrame, scratch: str, reach) -> None:
        """All steps of the jobs; reach(step) is called at each but the last."""
        parsed_at, n = f"{scratch}/parsed", [0]
        reach("parsing")
        markdown.parse(todo).write.parquet(parsed_at)  # parsed once, read by the four tables
        parsed = self.spark.read.parquet(parsed_at)
        reach("parsed")
        nodes = markdown.nodes_of(parsed)
        previous = self.store.read("nodes")
        old = indexing.prepared(previous.join(nodes.select("note_id").distinct(), "note_id", "left_semi"))
        dirty_at = f"{scratch}/dirty"
        indexing.dirty(indexing.prepared(nodes), old).write.parquet(dirty_at)
        reach("storing")
        self.store.replace_notes(nodes, markdown.tags_of(parsed), markdown.cross_refs_of(parsed))
        reach("stored")
        current = self.store.read("nodes").join(nodes.select("note_id").distinct(), "note_id", "left_semi")

        def write(df: DataFrame) -> DataFrame:
            n[0] += 1
            df.write.parquet(f"{scratch}/summaries{n[0]}")
            return self.spark.read.parquet(f"{scratch}/summaries{n[0]}")

        reach("summarizing")
        had = self.store.read("summaries")
        changed = self.spark.read.parquet(dirty_at).withColumn("changed", F.lit(True))
        said = had.select(F.col("node_id").alias("id"), "summary", "prompt_version", "generated_at")
        judged = indexing.non_leaves(current).select("id").join(changed, "id", "left").join(said, "id", "left")
        # a text that changes makes its node dirty, so a summary is never older than a clean node
        stands = indexing.may_skip(F.coalesce("changed", F.lit(False)), F.col("summary"), F.col("prompt_version"), F.col("generated_at"), F.col("generated_at"))
        made = indexing.summarize(current, judged.filter(~stands).select("id"), had, self.summarizer, write)
        self.store.upsert_summaries(made)
        reach("summarized")
        reach("embedding")
        content = indexing.need_content_vector(current, self.store.read("embeddings")).select("id", F.col("content").alias("text"), "content_hash")
        self.store.upsert_embeddings(indexing.embedded(content, self.embedder, "content"))
        told = indexing.need_summary_vector(current, self.store.read("summaries"), self.store.read("embeddings"))
        self.store.upsert_embeddings(indexing.embedded(told, self.embedder, "summary"))
        gate = path_matches(F.col("note_id"), self.daily_globs) if self.daily_globs else F.lit(True)
        counts = indexing.node_counts(current)
        meta = todo.select("note_id", F.col("note_id").alias("vault_path"), "content_hash", F.current_timestamp().alias("indexed_at"), note_date(F.col("note_id"), gate, self.date_pattern).alias("note_date"))
        self.store.upsert_note_meta(meta.join(counts, "note_id"))

    # --- reading

    def _version(self) -> str:
        """What names the present nodes, keywords and vectors."""
        tables = self.store._now()["tables"]
        return hashlib.sha256(json.dumps([tables.get(t) for t in ("nodes", "postings", "embeddings")], sort_keys=True).encode()).hexdigest()[:32]

    def optimize(self) -> str:
        """Writes the search indexes of the store as it is now: keyword blocks with their bounds, cells of vectors. Searches use them
        until a note changes, and read the tables after that, with the same answers."""
        version = self._version()
        base = f"{self.store.base}/_index/{version}"
        fs, path = self.store._fs()
        if not fs.exists(path(f"{base}/_DONE")):
            fs.delete(path(base), True)
            blockmax.build(self.store.read("postings")).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{base}/blocks")
            for kind in ("content", "summary"):
                vectors = self.store.read("embeddings").filter(F.col("vector_type") == kind).select(F.col("node_id").alias("id"), "embedding")
                CellIndex.build(vectors, f"{base}/{kind}")
            fs.create(path(f"{base}/_DONE"), True).close()
        for old in self.store._names("_index"):
            if old != version:
                fs.delete(path(f"{self.store.base}/_index/{old}"), True)
        return version

    def corpus(self) -> search.Corpus:
        s = self.store
        base = f"{s.base}/_index/{self._version()}"
        fs, path = s._fs()
        blocks, found = None, {}
        if fs.exists(path(f"{base}/_DONE")):
            blocks, found = self.spark.read.parquet(f"{base}/blocks"), {kind: CellIndex.read(self.spark, f"{base}/{kind}") for kind in ("content", "summary")}
        return search.Corpus(s.with_meta(), s.read("embeddings"), s.read("summaries"), s.read("tags"), s.read("postings"), s.stats(), blocks, found)

    def search(self, request: search.SearchRequest) -> DataFrame:
        return search.search(self.corpus(), request, lambda q: self.embedder.embed([q])[0])

    def chat(self, request: chat.ChatRequest):
        tools = agent.ToolRunner(self.corpus(), self.search) if self.planner else None
        return chat.run_chat(request, self.search, self.model, self.planner, tools)

    def chat_context(self, request: chat.ChatRequest) -> DataFrame:
        """The ranked rows that a chat turn would use."""
        request = chat.with_filters(request)
        return chat.stitch(self.search(chat.to_search(request)), chat.stitch_limit(request.stitch_tokens))

    def status(self) -> DataFrame:
        return jobs.status(self.store.read("queue_items"), self.store.read("job_steps"), QUEUE)

    def health(self) -> dict:
        return {"status": "ok", "uptime_s": time.time() - self.started, "db_ready": self.store.meta("embedding_dimension") is not None}
