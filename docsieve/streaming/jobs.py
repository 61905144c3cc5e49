"""Jobs over arriving files, as a structured stream: one job a file, results in a table, events for the jobs' state.

`run_jobs` does the work and writes results and events; `job_state.track` keeps the state of all jobs from the events; a reader asks by
`job_state.request_reads`, and `claimed` gives a result to the one request that got it; `forget` deletes what nobody can ask for any more.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs
from ..settings import DEFAULT, Settings
from ..storage import exists, materialize, scratch
from .job_state import EVENTS

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """Files as they arrive: doc_id, content, arrived. A file that comes again within an hour is the same job."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).load(folder)
    return (files.select(F.col("path").alias("doc_id"), "content", F.col("modificationTime").alias("arrived"))
            .withWatermark("arrived", "1 hour").dropDuplicatesWithinWatermark(["doc_id"]))


def job_id(path: str = "doc_id", arrived: str = "arrived"):
    """The id of the job of a file: the same whenever its batch runs again, and no one can guess another file's from it."""
    return F.substring(F.sha2(F.concat_ws("\n", F.col(path), F.unix_micros(arrived).cast("string")), 256), 1, 32)


def run_jobs(spark: SparkSession, folder: str, table: str, checkpoint: str, operation: Callable[[DataFrame], DataFrame],
             available_now: bool = True, events: str | None = None) -> StreamingQuery:
    """Start jobs: `operation` maps a batch of files to one row a doc_id with `error`; rows go to the Parquet folder `table`.

    A batch is written to a folder of its own, overwritten if it runs again, so a restart repeats no result. Its intermediate tables
    are deleted at its end. events: a folder for the events of the jobs (`job_state.EVENTS`); results then have a job_id.
    """
    def batch(files: DataFrame, number: int) -> None:
        with scratch(spark):
            if events:
                named = materialize(files.select("doc_id", job_id().alias("job_id"), "arrived"))
                _write(named.select("job_id", F.col("arrived").alias("at"), F.lit("submit").alias("kind")), f"{events}/submit={number}")
                _write(named.select("job_id", F.current_timestamp().alias("at"), F.lit("start").alias("kind")), f"{events}/start={number}")
            out = operation(files).withColumns({"state": F.lit("SUCCESS"), "failed": F.col("error").isNotNull(), "completed_at": F.current_timestamp()})
            if events:
                out = out.join(named.select("doc_id", "job_id"), "doc_id")
            out.write.mode("overwrite").parquet(f"{table}/batch={number}")
            if events:
                done = spark.read.parquet(f"{table}/batch={number}")
                _write(done.select("job_id", F.current_timestamp().alias("at"), F.when(F.col("failed"), "fail").otherwise("finish").alias("kind"), "error"),
                       f"{events}/end={number}")

    stream = watch(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime="5 seconds")).start()


def _write(rows: DataFrame, path: str) -> None:
    """Events of a batch, once: what a reader may have seen already isn't written again under another file name."""
    if not exists(rows.sparkSession, f"{path}/_SUCCESS"):
        rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
        rows.select(*re.findall(r"(\w+) \w+", EVENTS)).write.mode("overwrite").parquet(path)


def results(spark: SparkSession, table: str, consumed: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Results whose time isn't over and that weren't read before, with their status."""
    done = jobs.alive(spark.read.parquet(table), "completed_at", F.current_timestamp(), settings)
    if consumed is not None:
        done = jobs.unread(done, consumed, "doc_id")
    return done.withColumn("status", jobs.status_of(F.col("state"), F.col("failed")))


def current(transitions: DataFrame) -> DataFrame:
    """The state of each job (job_id, state, error, since) after its transitions; refusals change nothing."""
    place = F.array_position(F.array(*map(F.lit, ("queued", "processing", "stopping", "failed", "complete", "read", "expired"))), F.col("state"))
    last = F.max_by(F.struct("state", "error", F.col("at").alias("since")), F.struct("at", place))
    return transitions.where("state <> 'refused'").groupBy("job_id").agg(last.alias("x")).select("job_id", "x.*")


def claimed(spark: SparkSession, table: str, transitions: DataFrame) -> DataFrame:
    """Results whose one read was granted; the rows of all others stay out, whoever asks."""
    return spark.read.parquet(table).join(transitions.where("state = 'read'").select("job_id").distinct(), "job_id", "left_semi")


def forget(spark: SparkSession, table: str, transitions: DataFrame, before=None) -> int:
    """Delete results that were read or have expired (at or before `before`, a timestamp, if given); the number of batches that changed.

    A batch without any other result goes as a whole, others are written anew without the rows.
    """
    gone = transitions.where(F.col("state").isin("read", "expired"))
    gone = materialize((gone if before is None else gone.where(F.col("at") <= F.lit(before))).select("job_id").distinct())
    rows = spark.read.parquet(table)
    touched = rows.join(gone, "job_id", "left_semi").select("batch").distinct().collect()  # numbers of batches
    for (number,) in touched:
        path = f"{table}/batch={number}"
        left = materialize(spark.read.parquet(path).join(gone, "job_id", "left_anti"))
        left.write.mode("overwrite").parquet(path)
    return len(touched)
