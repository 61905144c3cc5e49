"""The life of jobs as keyed state of a stream: queued, processing, complete or failed, read once, expired.

Events (job_id, at, kind, error) come in; transitions (job_id, at, state, error) go out. Time limits and life times are timers of the
state: a job that runs past the soft limit is told to stop, one that doesn't stop within the grace after it has failed, and a result
that nobody reads in its life time is forgotten. A job that was read or has expired is remembered as such for one more life time, so
an event that is delivered again starts nothing; after that its state is gone too.

An event counts from its own time, or from the last one its job has seen where that is later. Deadlines before an event's time come
into force before the event, whether or not their timers have fired, so the outcome doesn't depend on how a stream is cut into
batches. `operators.jobs.lifecycle` gives the same states from a whole table of events.

Defined results: events without a job or a time are left out; unknown kinds and events that don't fit the state do nothing, but a
read always gets an answer: `read` once, else `refused`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.jobs import ERROR_INTERNAL, ERROR_LIMIT, KINDS
from ..settings import DEFAULT, Settings

EVENTS = "job_id string, at timestamp, kind string, error string"
TRANSITIONS = "job_id string, at timestamp, state string, error string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (state, time in microseconds at which it began, error); None for a job that isn't known
State = tuple[str, int, str | None] | None


def deadline(job: State, s: Settings) -> int | None:
    """When the state ends by itself."""
    if job is None or job[0] == "queued":
        return None
    seconds = {"processing": s.processing_timeout_seconds, "stopping": s.processing_grace_seconds}.get(job[0], s.job_ttl_seconds)
    return job[1] + seconds * 1_000_000


def expire(job: State, s: Settings) -> tuple[State, list[tuple]]:
    """The state after its deadline, and the transitions (at, state, error) to report."""
    state, at = job[0], deadline(job, s)
    after = {"processing": ("stopping", at, None), "stopping": ("failed", at, ERROR_INTERNAL), "complete": ("expired", at, None),
             "failed": ("expired", at, None)}.get(state)
    return after, [(at, after[0], after[2])] if after else []


def advance(job: State, now: int, s: Settings) -> tuple[State, list[tuple]]:
    """All deadlines up to now."""
    out: list[tuple] = []
    while (at := deadline(job, s)) is not None and at <= now:
        job, more = expire(job, s)
        out += more
    return job, out


def apply(job: State, kind: str, at: int, error: str | None, s: Settings) -> tuple[State, list[tuple]]:
    """The state after an event."""
    at = max(at, job[1]) if job else at
    job, out = advance(job, at, s)
    state = job[0] if job else None
    after: State = None
    if kind == "submit" and state is None:
        after = ("queued", at, None)
    elif kind == "start" and state == "queued":
        after = ("processing", at, None)
    elif kind in ("finish", "fail") and state == "stopping":
        after = ("failed", at, ERROR_LIMIT)
    elif kind == "finish" and state == "processing":
        after = ("complete", at, None)
    elif kind == "fail" and state == "processing":
        after = ("failed", at, error)
    elif kind == "read":
        if state != "complete":
            return job, [*out, (at, "refused", None)]
        after = ("read", at, None)
    return (after, [*out, (at, after[0], after[2])]) if after else (job, out)


class JobProcessor(StatefulProcessor):
    """One job's state and its next deadline as a timer."""

    def __init__(self, settings: Settings, event_time: bool):
        self.settings, self.event_time = settings, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, since long, error string, timer long")

    def _load(self) -> tuple[State, int | None]:
        if not self.job.exists():
            return None, None
        row = self.job.get()
        return (row[0], row[1], row[2]), row[3]

    def _store(self, job: State, timer: int | None) -> None:
        at = deadline(job, self.settings)
        at = None if at is None else -(-at // 1000)
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is not None and timer != at:
            self.handle.registerTimer(at)
        if job is None:
            self.job.clear()
        else:
            self.job.update((*job, at))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        job, timer = self._load()
        out: list[tuple] = []
        for r in sorted(rows, key=lambda r: (r["us"], KINDS.index(r["kind"]))):
            job, more = apply(job, r["kind"], r["us"], r["error"], self.settings)
            out += more
        self._store(job, timer)
        yield from (Row(job_id=key[0], us=at, state=state, error=error) for at, state, error in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        job, timer = self._load()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        job, out = advance(job, max(fired, now) * 1000, self.settings)  # the next deadline may be over as well
        self._store(job, None if timer == fired else timer)
        yield from (Row(job_id=key[0], us=at, state=state, error=error) for at, state, error in out)

    def close(self) -> None:
        pass


def track(events: DataFrame, settings: Settings = DEFAULT, late: str | None = None) -> DataFrame:
    """Transitions of the jobs of a stream of EVENTS.

    Deadlines go by the clock; with `late` (such as '10 seconds') they go by the time of events, which may be that much out of order.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    good = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS))
    if late:
        good = good.withWatermark("at", late)
    good = good.select("job_id", "at", "kind", "error", F.unix_micros("at").alias("us"))
    out = good.groupBy("job_id").transformWithState(
        JobProcessor(settings, bool(late)), "job_id string, us long, state string, error string", "Append", "EventTime" if late else "ProcessingTime")
    return out.select("job_id", F.timestamp_micros("us").alias("at"), "state", "error")


def read_events(spark: SparkSession, folder: str, max_files: int = 256) -> DataFrame:
    """The stream of events that run_jobs and request_reads write."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).parquet(folder)


def request_reads(spark: SparkSession, folder: str, job_ids: list[str]) -> None:
    """Ask for results; `track` answers each request with `read` (once a job) or `refused`."""
    rows = spark.createDataFrame([(x,) for x in job_ids], "job_id string")
    rows.select("job_id", F.current_timestamp().alias("at"), F.lit("read").alias("kind"), F.lit(None).cast("string").alias("error")).write.mode("append").parquet(folder)


def keep_transitions(transitions: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the transitions to a Parquet folder; a batch that runs again overwrites its own, so a restart repeats none.

    available_now is for deadlines by the time of events: by the clock there is always another batch, and the stream runs on.
    """
    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = transitions.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime="5 seconds")).start()
