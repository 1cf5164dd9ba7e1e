"""Runs that die, steps that are told, and how the store writes."""

import warnings

import pytest
from pyspark.sql import functions as F

from notespark import schemas
from notespark.engine import GONE, STEPS, Engine
from notespark.sources import store as S
from notespark.sources.store import Conflict, Store


def files(spark, notes):
    return spark.createDataFrame(list(notes.items()), "path string, content string").withColumn("hash", F.sha2("content", 256))


NOTES = {"a.md": "# A\n\none", "b.md": "# B\n\ntwo"}


class Killed(BaseException):
    pass


def die(*_):
    raise Killed


def counts(engine):
    r = engine.status().first()
    return r.pending, r.processing, r.completed, r.dead_letter


def test_a_killed_run_is_taken_up(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/s"
    first = Engine(spark, base)
    first.index(files(spark, NOTES | {"old.md": "# Old"}))
    monkeypatch.setattr(Engine, "_process", die)
    with pytest.raises(Killed):
        first.index(files(spark, {"a.md": "# A\n\nchanged", "b.md": NOTES["b.md"], "c.md": "# C"}), prune=True)
    monkeypatch.undo()
    assert first.status().first().processing == 2
    assert {r.current_step for r in first.store.read("job_steps").collect()} == {"embedded", "parsing"}
    second = Engine(spark, base)
    assert counts(second) == (2, 0, 3, 0)  # what was processing waits again
    assert {r.current_step for r in second.store.read("job_steps").collect()} == {"embedded", "queued"}
    run = second.index(files(spark, {"a.md": "# A\n\nchanged", "b.md": NOTES["b.md"], "c.md": "# C"}))
    assert (run["enqueued"], run["skipped"]) == (0, 3) and counts(second) == (0, 0, 5, 0)
    assert {r.content for r in second.store.read("nodes").filter("note_id = 'a.md'").collect()} == {"A", "changed", "a"} or second.store.read("nodes").filter("content = 'changed'").count() == 1
    assert second.store.read("nodes").filter("note_id = 'old.md'").isEmpty()  # the dead run's deletions too
    assert second.store._names("_run") == [] and second.resume() == 0


def test_jobs_without_files_are_dead_letters(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/s"
    e = Engine(spark, base)
    monkeypatch.setattr(Engine, "_process", die)
    with pytest.raises(Killed):
        e.index(files(spark, NOTES))
    monkeypatch.undo()
    fs, path = e.store._fs()
    fs.delete(path(f"{base}/_run"), True)
    again = Engine(spark, base)
    run = again.index(files(spark, NOTES))
    assert run["enqueued"] == 2 and again.status().first().pending == 0
    lost = again.store.read("queue_items").filter("status = 'dead_letter'").collect()
    assert [r.error_message for r in lost] == [GONE] * 2
    assert again.store.read("nodes").select("note_id").distinct().count() == 2


def test_waves_and_steps_and_sinks(spark, tmp_path):
    told = []

    def broken(events):
        raise OSError("no line")

    e = Engine(spark, f"file://{tmp_path}/s", wave=2, buckets=3, sinks=(broken, lambda ev: told.append({(r.note_path, r.step) for r in ev.collect()})))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        run = e.index(files(spark, NOTES | {"c.md": "# C"}))
    assert run["enqueued"] == 3 and e.store.buckets == 3 and any("no line" in str(w.message) for w in said)
    assert len(told) == 2 * len(STEPS) and set.union(*told) == {(n, s) for n in ("a.md", "b.md", "c.md") for s in STEPS}
    events = e.store.read("progress_events").orderBy("note_path", "at").collect()
    assert [r.step for r in events if r.note_path == "a.md"] == list(STEPS)
    assert Store(spark, f"file://{tmp_path}/s", 64).buckets == 3


def test_appends_are_compacted_and_a_lost_rename_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_FOLDERS", 3)
    s = Store(spark, f"file://{tmp_path}/s", 4, buckets=1)
    row = lambda k: spark.createDataFrame([(f"n{k}", "t", "inline")], schemas.TAGS)
    for k in range(5):
        s.append("tags", row(k))
    assert s.read("tags").count() == 5 and max(len(f) for f in s._now()["tables"]["tags"].values()) <= 3

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda *a: False) if name == "rename" else getattr(self.fs, name)

    fs, path = s._fs()
    monkeypatch.setattr(s, "_fs", lambda: (Fs(fs), path))
    with pytest.raises(Conflict):
        s.append("tags", row(9))
    monkeypatch.undo()
    assert s.read("tags").count() == 5
