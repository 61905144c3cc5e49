"""States, life time and one-time reads of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings
from ..storage import materialize

#: Kinds of job events, in the order in which those of one time count.
KINDS = ("submit", "start", "fail", "finish", "read")
#: Errors.
ERROR_LIMIT = "Processing exceeded the allotted time limit."
ERROR_INTERNAL = "Internal processing error."


def status_of(state: Column, payload_failed: Column) -> Column:
    """Reported status of a queue state; unknown states are queued."""
    return (F.when(state == "STARTED", "processing").when(state == "FAILURE", "failed")
            .when((state == "SUCCESS") & F.coalesce(payload_failed, F.lit(False)), "failed").when(state == "SUCCESS", "complete")
            .otherwise("queued"))


def reported(state: Column) -> Column:
    """Reported status of a job's state; jobs that aren't known, or not any more, are queued."""
    return F.when(state == "stopping", "processing").when(state.isin("processing", "complete", "failed"), state).otherwise("queued")


def latest(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last value of each key in the order of the columns."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def alive(done: DataFrame, at: str, now: Column, settings: Settings = DEFAULT) -> DataFrame:
    """Results whose life time isn't over."""
    return done.where(F.col(at) + F.make_dt_interval(secs=F.lit(settings.job_ttl_seconds)) > now)


def unread(done: DataFrame, consumed: DataFrame, key: str) -> DataFrame:
    """Results that weren't read before; a result can be read once."""
    return done.join(consumed.select(key).distinct(), key, "left_anti")


def lifecycle(events: DataFrame, now: Column | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The state of each submitted job at the time `now` (default: all events and no deadline after the last of them in the table).

    events: job_id, at, kind (KINDS), error. Out: job_id, state, since, error. The same rules as `streaming.job_state`, over a whole
    table: each step is one aggregation a job, over the events of its kind; what a job's earlier steps gave is a written table of a row
    a job, so that the events of a job with very many of them are split among tasks.
    """
    rows = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull()).select("job_id", "at", "kind", "error")
    if now is None:
        rows = rows.join(F.broadcast(rows.agg(F.max("at").alias("now"))))
    else:
        rows = rows.withColumn("now", now)
    rows = rows.where(F.col("at") <= F.col("now"))
    after = lambda c, seconds: F.col(c) + F.make_dt_interval(secs=F.lit(seconds))
    kind = lambda *k: rows.where(F.col("kind").isin(*k))
    queued = materialize(kind("submit").groupBy("job_id").agg(F.min("at").alias("submitted"), F.first("now").alias("now")))
    started = materialize(kind("start").select("job_id", "at").join(queued.select("job_id", "submitted"), "job_id").where("at >= submitted")
                          .groupBy("job_id").agg(F.min("at").alias("started")))
    ended = materialize(kind("finish", "fail").select("job_id", "at", "kind", "error").join(started, "job_id").where("at >= started")
                        .groupBy("job_id").agg(F.min(F.struct("at", "kind", "error")).alias("end")))
    jobs = queued.join(started, "job_id", "left").join(ended, "job_id", "left")
    soft, hard, end = after("started", settings.processing_timeout_seconds), after("started", settings.processing_timeout_seconds + settings.processing_grace_seconds), F.col("end")
    intime = F.coalesce(end["at"] < soft, F.lit(False))
    stopped = ~intime & F.coalesce(end["at"] < hard, F.lit(False))
    jobs = jobs.withColumns({
        "done": F.when(intime | stopped, end["at"]).when(hard <= F.col("now"), hard),
        "outcome": F.when(intime & (end["kind"] == "finish"), "complete").when(F.col("started").isNotNull(), "failed"),
        "why": F.when(intime & (end["kind"] == "fail"), end["error"]).when(stopped, ERROR_LIMIT).when(~intime, ERROR_INTERNAL)})
    jobs = materialize(jobs.withColumn("over", after("done", settings.job_ttl_seconds)))
    read = (kind("read").select("job_id", "at").join(jobs.where("outcome = 'complete'").select("job_id", "done", "over"), "job_id")
            .where("at >= done and at < over").groupBy("job_id").agg(F.min("at").alias("read")))
    out = jobs.join(read, "job_id", "left")
    state = (F.when(F.col("read").isNotNull(), F.struct(F.lit("read").alias("state"), F.col("read").alias("since")))
             .when(F.col("over") <= F.col("now"), F.struct(F.lit("expired").alias("state"), F.col("over").alias("since")))
             .when(F.col("done").isNotNull(), F.struct(F.col("outcome").alias("state"), F.col("done").alias("since")))
             .when(soft <= F.col("now"), F.struct(F.lit("stopping").alias("state"), soft.alias("since")))
             .when(F.col("started").isNotNull(), F.struct(F.lit("processing").alias("state"), F.col("started").alias("since")))
             .otherwise(F.struct(F.lit("queued").alias("state"), F.col("submitted").alias("since"))))
    out = out.select("job_id", state.alias("s"), "why")
    return out.select("job_id", "s.state", "s.since", F.when(F.col("s.state") == "failed", F.col("why")).alias("error"))


MEDIA_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpeg": "image/jpeg", "tiff": "image/tiff"}


def media_type(fmt: Column) -> Column:
    case = F
    for name, kind in MEDIA_TYPES.items():
        case = case.when(fmt == name, kind)
    return case.otherwise("application/octet-stream")
