from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notespark import schemas
from notespark.operators import jobs
from notespark.sources import progress
from notespark.streaming import fsm, ingest, watch


def test_rules():
    assert jobs.ensure(None, 0) == ("queued", 0) and jobs.ensure("failed", 0) == ("queued", 1) and jobs.ensure("parsing", 0) == ("queued", 0) and jobs.ensure("embedded", 2) == ("embedded", 2)
    assert jobs.ensure("failed", 3) == ("dead_letter", 4) and jobs.move("parsing", "parsing", 1) == ("parsing", 1) and jobs.fail("embedded") == "embedded"
    for bad in (("queued", "stored"), ("embedded", "parsing")):
        with pytest.raises(ValueError):
            jobs.move(*bad, 0)


def test_queue(spark):
    q = spark.createDataFrame([], schemas.QUEUE)
    q = jobs.enqueue(q, spark.createDataFrame([("a", "index", "{}"), ("b", "index", "{}")], "id string, queue_name string, payload string"))
    first = jobs.dequeue(q, "index", 8, 1)
    assert first.count() == 1 and jobs.dequeue(q, "index", 8, 1, 1).count() == 0
    q = jobs.with_status(q, spark.createDataFrame([("a",)], "id string"), "processing")
    assert {r.id: r.status for r in jobs.reclaim(q).collect()} == {"a": "pending", "b": "pending"}
    for n in range(1, 5):
        q = jobs.nack(q, spark.createDataFrame([("a", "e")], "id string, error string"))
        r = q.filter("id = 'a'").first()
        assert (r.status, r.retry_count, r.error_message) == ("dead_letter" if n > 3 else "pending", n, "e")


EVENTS = [("j", 1, "ensure", None, 0), ("j", 2, "move", "parsing", 1), ("j", 3, "move", "stored", 2), ("j", 4, "fail", None, 3), ("j", 5, "ensure", None, 4), ("j", 5, "ensure", None, 4), ("k", 1, "ensure", None, 0)]
COLUMNS = "job_id string, seq long, action string, to_step string, at timestamp"


def job_events(spark, rows):
    return spark.createDataFrame([(*r[:4], datetime(2026, 1, 1, 0, r[4])) for r in rows], COLUMNS)


def machine(spark, tmp_path, batches, **options):
    """The stream over batches, one file each, stopped and started again before each."""
    (tmp_path / "in").mkdir(exist_ok=True)
    stream = spark.readStream.schema(COLUMNS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        out = fsm.replay(fsm.run(stream, **options), f"{tmp_path}/out", f"{tmp_path}/cp")
    return out


def test_machine_batch_and_stream_agree(spark, tmp_path):
    rows = job_events(spark, EVENTS)
    want = {(r.job_id, r.seq): (r.step, r.retry_count, r.error) for r in fsm.run_batch(rows).collect()}
    assert want["j", 3][:2] == ("parsing", 0) and want["j", 3][2] and want["j", 5] == ("queued", 1, None) and len(want) == 6
    out = machine(spark, tmp_path, (rows.filter("seq <= 3"), rows.filter("seq > 3"), rows.filter("seq = 5")))  # the last batch is a replay
    got = out.collect()
    assert len(got) == 6 and {(r.job_id, r.seq): (r.step, r.retry_count, r.error) for r in got} == want


def test_machine_begins_with_stored_jobs_and_fails_those_that_hang(spark, tmp_path):
    stored = spark.createDataFrame([("old", "failed", 3), ("done", "embedded", 0)], "job_id string, current_step string, retry_count int")
    first = job_events(spark, [("old", 1, "ensure", None, 0), ("done", 1, "ensure", None, 0), ("slow", 1, "ensure", None, 0), ("slow", 2, "move", "parsing", 1), ("quick", 1, "ensure", None, 1)])
    later = job_events(spark, [("clock", 1, "ensure", None, 59)])
    out = machine(spark, tmp_path, (first, later, job_events(spark, [("slow", 3, "ensure", None, 59)])), patience_s=600, late="1 minute", initial=stored)
    got = {(r.job_id, r.seq, r.step, r.retry_count, r.error) for r in out.collect()}
    assert {("old", 1, "dead_letter", 4, None), ("done", 1, "embedded", 0, None), ("quick", 1, "queued", 0, None)} <= got
    assert ("slow", 2, "failed", 0, "no progress in parsing") in got and ("slow", 3, "queued", 1, None) in got


def test_note_stream_is_indexed(spark, tmp_path):
    from notespark.engine import Engine

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text(f"# N{i}\n\nbody")
    e = Engine(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest.start(ingest.file_stream(spark, f"file://{tmp_path}/in", 2), e, f"{tmp_path}/cp").awaitTermination(180)
    assert e.store.read("note_meta").count() == 3


def test_windows_count_late_and_repeated_events_once(spark, tmp_path):
    at = lambda m: datetime(2026, 1, 1, 0, m)
    cols = "job_id string, run_id string, step string, status string, at timestamp"
    batches = [[("a", "r", "parsing", "processing", at(1)), ("b", "r", "parsing", "processing", at(7))], [("c", "r", "parsing", "processing", at(2)), ("a", "r", "parsing", "processing", at(1))], [("z", "s", "embedded", "completed", at(59))]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(cols).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        windows = fsm.replay(ingest.progress_windows(stream), f"{tmp_path}/w", f"{tmp_path}/wc")
        spells = fsm.replay(ingest.run_sessions(stream), f"{tmp_path}/s", f"{tmp_path}/sc")
    got = {(r.window.start.minute, r.step, r.n) for r in windows.collect()}
    every = spark.createDataFrame([x for b in batches[:2] for x in b], cols).dropDuplicates(["job_id", "step", "status"])
    assert got == {(r.window.start.minute, r.step, r.n) for r in every.groupBy(F.window("at", "5 minutes"), "step").agg(F.count("*").alias("n")).collect()} == {(0, "parsing", 2), (5, "parsing", 1)}
    assert [(r.run_id, r.window.start.minute, r.events, r.jobs, r.dead) for r in spells.collect()] == [("r", 1, 3, 3, 0)]


def test_folder_changes_reach_the_store(spark, tmp_path):
    from notespark.engine import Engine

    folder, told = tmp_path / "vault", []
    folder.mkdir()
    e = Engine(spark, f"file://{tmp_path}/store")

    def turn():
        watch.start(spark, f"file://{folder}", e, f"file://{tmp_path}/cp", told=lambda c: told.append(sorted(tuple(r) for r in c.collect()))).awaitTermination(300)
        return {r.note_id for r in e.store.read("note_meta").collect()}

    (folder / "a.md").write_text("# A")
    (folder / "b.md").write_text("# B")
    assert turn() == {"a.md", "b.md"} and told[-1] == [("a.md", "added", None), ("b.md", "added", None)]
    (folder / "a.md").write_text("# A changed")
    (folder / "c.md").write_text("# C")
    (folder / "b.md").rename(folder / "d.md")
    assert turn() == {"a.md", "c.md", "d.md"}
    assert told[-1] == [("a.md", "changed", None), ("b.md", "deleted", None), ("c.md", "added", None), ("d.md", "added", "b.md")]
    (folder / "c.md").unlink()
    assert turn() == {"a.md", "d.md"} and told[-1] == [("c.md", "deleted", None)]
    assert turn() == {"a.md", "d.md"} and len(told) == 3  # a new start with nothing changed
    assert e.store.read("nodes").filter("content = 'A changed'").count() == 1


def test_progress_source_tells_each_reader_once(spark, tmp_path):
    folder, cols = f"file://{tmp_path}/p", ", ".join(schemas.PROGRESS.split(", "))
    progress.register(spark)
    event = lambda k: (f"j{k}", "r", "n.md", "parsing", "processing", None, datetime(2026, 1, 1, 0, k))

    def readers():
        for name in ("one", "two"):
            stream = spark.readStream.format("notes_progress").option("path", folder).load()
            yield sorted(r.job_id for r in fsm.replay(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp").collect())

    for k in (1, 2):
        progress.sink(folder)(spark.createDataFrame([event(k), event(k + 10)], cols))
        assert list(readers()) == [sorted(f"j{i + 10 * t}" for i in range(1, k + 1) for t in (0, 1))] * 2
    broken = spark.createDataFrame([event(5)], cols).withColumn("step", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("notes_progress").option("path", folder).mode("append").save()
    assert spark.read.format("notes_progress").option("path", folder).load().count() == 4 and [len(x) for x in readers()] == [4, 4]


def test_newest_version_of_a_note_wins(spark):
    rows = spark.createDataFrame([("a.md", "old", "z", 1), ("a.md", "new", "a", 2), ("b.md", "x", "h", 1), ("b.md", "y", "i", 1)], "path string, content string, hash string, modified int")
    assert sorted((r.path, r.content) for r in ingest.newest(rows).collect()) == [("a.md", "new"), ("b.md", "y")]
