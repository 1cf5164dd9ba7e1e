"""The job state machine over a stream of events, keyed by job; the rules are those of operators/jobs.py.

State is typed and kept by transformWithState. It may begin with the job_steps table of a store. A job that stays in a working step for
`patience` of event time fails by a timer, so late or lost workers do not keep jobs open for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import jobs

OUT = "job_id string, seq long, step string, retry_count int, error string"
STATE = "step string, retries int, seen long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def apply(step: str | None, retries: int, seen: int, events: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """Events (seq, action, to_step) of one job: ensure, move, fail. An event of a number already seen changes nothing. Returns the state
    (step, retries, seen) after them, and (seq, step, retries, error) after each."""
    rows = []
    for e in events.sort_values("seq", kind="stable").itertuples():
        if e.seq <= seen:
            continue
        error = None
        try:
            if e.action == "ensure":
                step, retries = jobs.ensure(step, retries)
            elif e.action == "fail":
                step = jobs.fail(step) if step else "failed"
            else:
                step, retries = jobs.move(step or "queued", e.to_step, retries)
        except ValueError as x:
            error = str(x)
        seen = int(e.seq)
        rows.append((seen, step, retries, error))
    return (step, retries, seen), rows


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *r) for r in rows], columns=["job_id", "seq", "step", "retry_count", "error"])


class JobStates(StatefulProcessor):
    def __init__(self, patience_s: float):
        self.patience_s = patience_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _now(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (None, 0, -1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        state, out = apply(*self._now(), events)
        if not out:
            return
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[0] in jobs.FORWARD and state[0] != "queued":
            self.handle.registerTimer(int(pd.Timestamp(events["at"].max()).timestamp() * 1000 + self.patience_s * 1000))
        yield _frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, retries, seen = self._now()
        self.state.update((jobs.fail(step), retries, seen))
        yield _frame(key, [(seen, jobs.fail(step), retries, f"no progress in {step}")])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        first = initialState.iloc[0]
        self.state.update((first["current_step"], int(first["retry_count"]), -1))

    def close(self) -> None:
        pass


class StepAudit(StatefulProcessor):
    """Steps that may not follow the one before, as jobs.illegal_steps finds them in a table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "step string, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, seen = tuple(self.last.get()) if self.last.exists() else (None, None)
        out = []
        for e in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if seen is not None and e.seq <= seen:
                continue  # told already
            if before is not None and before != e.step and e.step not in jobs.FORWARD.get(before, ()):
                out.append((key[0], int(e.seq), before, e.step))
            before, seen = e.step, int(e.seq)
        self.last.update((before, seen))
        yield pd.DataFrame(out, columns=["job", "seq", "from_step", "step"])

    def close(self) -> None:
        pass


@contextmanager
def typed_state(spark: SparkSession):
    """Queries that are started inside keep their state where transformWithState needs it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run(events: DataFrame, patience_s: float = 3600, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """events(job_id, seq, action, to_step, at), a stream, to the state after each; initial: job_steps to begin with. Start it inside
    typed_state()."""
    first = None if initial is None else initial.select("job_id", "current_step", "retry_count").groupBy("job_id")
    return events.withWatermark("at", late).groupBy("job_id").transformWithStateInPandas(JobStates(patience_s), OUT, "Append", "EventTime", initialState=first)


def audit(steps: DataFrame) -> DataFrame:
    """steps(job, seq, step), a stream, to the illegal ones (job, seq, from_step, step). Start it inside typed_state()."""
    return steps.groupBy("job").transformWithStateInPandas(StepAudit(), "job long, seq long, from_step string, step string", "Append", "None")


def run_batch(events: DataFrame) -> DataFrame:
    """The machine over a table."""

    def of_job(key, pdf):
        return _frame(key, apply(None, 0, -1, pdf)[1])

    return events.groupBy("job_id").applyInPandas(of_job, OUT)


def replay(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that a stream has by now, through to the folder `out`."""
    spark = stream.sparkSession
    with typed_state(spark):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*[F.col(c) for c in stream.columns])
