"""Earlier saves that an incrementally updated PDF still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes_ops import boundary_offsets, latin1
from ..settings import DEFAULT, Settings

#: Summaries.
SUMMARY_PRIOR = ("%d prior revision(s) found still recoverable from this document's incremental-save history, in addition to its current "
                 "state. If any of those revisions predate a redaction or content removal, that earlier content may still be extractable "
                 "from this file.")
SUMMARY_NONE = "No prior revisions detected — this document does not appear to carry incremental-save history."
SUMMARY_UNPARSED = ("%d revision boundary marker(s) found, but none besides the current state could be parsed as a standalone recoverable "
                    "document.")


def boundaries(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """doc_id, length, offsets: end offsets of the boundaries in each file's bytes, capped."""
    most = settings.forensics_max_boundary_candidates
    return files.select("doc_id", F.octet_length("content").cast("long").alias("length"),
                        boundary_offsets(latin1(F.col("content")), most=most).alias("offsets"))


def revisions(bounds: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row a boundary, oldest first and capped: doc_id, revision_index (from 1), boundary_end_offset, size_bytes, is_current."""
    last = F.col("length") if settings.strict else F.col("length") - 1  # one byte may follow the last boundary
    return (bounds.select("doc_id", "length", F.posexplode("offsets").alias("pos", "boundary_end_offset"))
            .where(F.col("pos") < settings.forensics_max_revisions_reported)
            .select("doc_id", (F.col("pos") + 1).alias("revision_index"), "boundary_end_offset",
                    F.col("boundary_end_offset").alias("size_bytes"), (F.col("boundary_end_offset") >= last).alias("is_current")))


def report(revs: DataFrame, bounds: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row a document: total_revisions_found, pages_in_current_revision, summary, truncated.

    revs: revisions with openable and page_count; documents without boundaries come from bounds.
    """
    per = revs.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if("openable").alias("n_open"),
        F.count_if(F.col("openable") & ~F.col("is_current")).alias("prior"),
        F.max_by("page_count", F.when(F.col("is_current") & F.col("openable"), F.col("revision_index"))).alias("pages"),
        F.max(F.when(F.col("is_current") & F.col("openable"), True)).alias("has_current"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return bounds.select("doc_id", F.size("offsets").alias("found")).join(per, "doc_id", "left").select(
        "doc_id", n("total").alias("total_revisions_found"), F.when(F.col("has_current"), F.col("pages")).cast("int").alias("pages_in_current_revision"),
        F.when(n("prior") > 0, F.format_string(SUMMARY_PRIOR, n("prior"))).when(n("n_open") <= 1, SUMMARY_NONE)
        .otherwise(F.format_string(SUMMARY_UNPARSED, n("n_open"))).alias("summary"),
        ((F.col("found") >= settings.forensics_max_boundary_candidates) | (n("total") >= settings.forensics_max_revisions_reported)).alias("truncated"))
