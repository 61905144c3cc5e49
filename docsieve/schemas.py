"""The records that leave the engine: job envelopes with nested findings and revisions, as typed columns.

Text beneath redactions is in none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.geometry import RECT
from .operators.jobs import reported
from .settings import DEFAULT, Settings

JOB_STATUS = ("queued", "processing", "complete", "failed")
#: Where the jobs of each operation are polled.
POLL = {"process": "/api/v1/documents/", "audit": "/api/v1/audit/redactions/", "revisions": "/api/v1/forensics/revisions/",
        "extraction": "/api/v1/forensics/revisions/extract/"}
FINDING = (f"struct<page_number:int,rect:{RECT},source:string,risk_level:string,underlying_word_count:int,underlying_char_count:int,note:string>")
REVISION = ("struct<revision_index:int,size_bytes:bigint,is_current:boolean,page_count:int,object_count:int,creation_date:string,mod_date:string,"
            "openable:boolean,note:string>")
#: Names and types of the envelopes' columns, in order.
ENVELOPES = {
    "job_submit": "job_id string, status string, poll_url string",
    "job_status": ("job_id string, status string, kind string, pages_flagged int, elapsed_seconds double, error string, download_url string, "
                   "expires_in_seconds int"),
    "redaction_audit": ("job_id string, status string, error string, pages_audited int, total_boxes_found int, critical_count int, clear_count int, "
                        f"summary string, findings array<{FINDING}>"),
    "revision_discovery": ("job_id string, status string, error string, total_revisions_found int, pages_in_current_revision int, summary string, "
                           f"truncated boolean, revisions array<{REVISION}>"),
    "revision_extraction": "job_id string, status string, error string, revision_index int, download_url string, expires_in_seconds int",
}


def envelope(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of an envelope, in its types; those that df doesn't have are null."""
    fields = df.sparkSession.createDataFrame([], ENVELOPES[name]).schema.fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def submitted(jobs: DataFrame, operation: str = "process") -> DataFrame:
    """What a submission is answered with. jobs: job_id."""
    return envelope(jobs.select("job_id", F.lit("queued").alias("status"), F.concat(F.lit(POLL[operation]), "job_id").alias("poll_url")), "job_submit")


def _polled(asked: DataFrame, states: DataFrame) -> DataFrame:
    """asked (job_id) with the reported status and the error of failed jobs; jobs that aren't known are queued. states: job_id, state, error."""
    known = states.select("job_id", reported(F.col("state")).alias("status"), F.col("error").alias("job_error"))
    return asked.select("job_id").join(known, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("queued")))


def _complete(c: str | Column) -> Column:
    return F.when(F.col("status") == "complete", c if isinstance(c, Column) else F.col(c))


def job_status(asked: DataFrame, states: DataFrame, results: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row a job that is asked for. results: doc_id (the job), kind, pages_flagged, elapsed_seconds."""
    rows = _polled(asked, states).join(results.select(F.col("doc_id").alias("job_id"), "kind", "pages_flagged", "elapsed_seconds"), "job_id", "left")
    return envelope(rows.select(
        "job_id", "status", F.when(F.col("status") == "failed", F.col("job_error")).alias("error"), *(_complete(c).alias(c) for c in ("kind", "pages_flagged", "elapsed_seconds")),
        _complete(F.concat(F.lit(POLL["process"]), "job_id", F.lit("/download"))).alias("download_url"),
        _complete(F.lit(settings.job_ttl_seconds)).alias("expires_in_seconds")), "job_status")


def _nested(rows: DataFrame, name: str, kind: str, order: list[str]) -> DataFrame:
    """job_id and the rows of each job as an array in order; a job's rows are those of one document, whose number the limits bound."""
    fields = rows.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType
    one = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).cast(fields)
    placed = F.array_sort(F.collect_list(F.struct(*order, one.alias("one"))))
    return rows.groupBy(F.col("doc_id").alias("job_id")).agg(F.transform(placed, lambda x: x["one"]).alias(name))


def redaction_audit(asked: DataFrame, states: DataFrame, findings: DataFrame, reports: DataFrame) -> DataFrame:
    """One row a job that is asked for, with its findings in the order of pages, sources and boxes."""
    rows = (_polled(asked, states).join(reports.withColumnRenamed("doc_id", "job_id"), "job_id", "left")
            .join(_nested(findings, "findings", FINDING, ["page_number", "source_order", "seq"]), "job_id", "left"))
    own = ("pages_audited", "total_boxes_found", "critical_count", "clear_count", "summary")
    none = F.array().cast(f"array<{FINDING}>")
    return envelope(rows.select("job_id", "status", F.when(F.col("status") == "failed", F.col("job_error")).alias("error"), *(_complete(c).alias(c) for c in own),
                                _complete(F.coalesce("findings", none)).alias("findings")), "redaction_audit")


def revision_discovery(asked: DataFrame, states: DataFrame, revisions: DataFrame, reports: DataFrame) -> DataFrame:
    """One row a job that is asked for, with its revisions, oldest first."""
    rows = (_polled(asked, states).join(reports.withColumnRenamed("doc_id", "job_id"), "job_id", "left")
            .join(_nested(revisions, "revisions", REVISION, ["revision_index"]), "job_id", "left"))
    own = ("total_revisions_found", "pages_in_current_revision", "summary", "truncated")
    none = F.array().cast(f"array<{REVISION}>")
    return envelope(rows.select("job_id", "status", F.when(F.col("status") == "failed", F.col("job_error")).alias("error"), *(_complete(c).alias(c) for c in own),
                                _complete(F.coalesce("revisions", none)).alias("revisions")), "revision_discovery")


def revision_extraction(asked: DataFrame, states: DataFrame, results: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row a job that is asked for. results: doc_id (the job), revision_index."""
    rows = _polled(asked, states).join(results.select(F.col("doc_id").alias("job_id"), "revision_index"), "job_id", "left")
    return envelope(rows.select(
        "job_id", "status", F.when(F.col("status") == "failed", F.col("job_error")).alias("error"), _complete("revision_index").alias("revision_index"),
        _complete(F.concat(F.lit(POLL["extraction"]), "job_id", F.lit("/download"))).alias("download_url"),
        _complete(F.lit(settings.job_ttl_seconds)).alias("expires_in_seconds")), "revision_extraction")
