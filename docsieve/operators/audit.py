"""Redaction audit: opaque boxes and the text that is still beneath them. Nothing here changes a document.

The text itself is no column of any result. reveal() gives it for a single document on explicit request.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..settings import DEFAULT, Settings

PAGE = ["doc_id", "page_number"]
ANNOTATION, VECTOR, IMAGE = "unapplied_redact_annotation", "vector_fill", "image_overlay"
#: Notes and summaries.
NOTE_ANNOTATION = "A redaction annotation was placed but never applied — the marked content was never actually removed from the page."
NOTE_CRITICAL = ("Opaque box detected with extractable text underneath — this redaction likely only covers the content visually and can be "
                 "recovered by selecting/copying or programmatic text extraction.")
NOTE_CLEAR = ("Opaque box detected with no extractable text underneath. This is consistent with a properly burned-in redaction, but cannot "
              "rule out a flattened/rasterized page where no text layer exists at all — verify the box's origin if this document started "
              "as a scan.")
SUMMARY_CRITICAL = ("%d potential redaction failure(s) found: opaque box(es) with extractable text still present underneath. Treat this "
                    "document as NOT safely redacted until remediated.")
SUMMARY_CLEAR = ("%d opaque box(es) reviewed; none had extractable text underneath. No redaction failures detected by this method — see "
                 "per-finding notes for coverage limitations.")
SUMMARY_NONE = "No candidate redaction boxes were found on this document."


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right by sorting. Relations of files are compressed so well that Spark takes millions of rows for few and would
    broadcast them all, so that every executor and the driver hold as much as there is input."""
    return left.join(right.hint("merge"), keys, how)


def _area(s: Settings) -> Column:
    return g.area_qualifies(F.col("rect"), F.col("page_rect"), s.audit_min_box_area_ratio, s.audit_max_box_area_ratio)


def vector_candidates(drawings: DataFrame, pdf_pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Filled boxes that are opaque, dark and of a redaction's size. An opacity of 0 counts as fully opaque."""
    o = F.col("fill_opacity")
    opacity = F.when(o.isNull() | (o == 0), F.lit(1.0)).otherwise(o)
    keep = (F.size("fill") > 0) & F.col("rect").isNotNull() & (opacity >= settings.audit_min_opacity)
    if not settings.audit_any_solid_color:
        keep = keep & g.is_dark(F.col("fill"), settings.audit_darkness_threshold)
    return _met(drawings.where(keep), pdf_pages, PAGE).where(_area(settings)).select(*PAGE, "seq", "rect", F.lit(VECTOR).alias("source"))


def image_candidates(page_images: DataFrame, pdf_pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Images of one flat, not too light colour, by the variance and mean of their samples.

    page_images: doc_id, page_number, seq, rect, variance, mean_intensity; images that couldn't be read have nulls.
    """
    keep = F.col("variance") <= settings.audit_image_color_variance_max
    if not settings.audit_any_solid_color:
        keep = keep & (F.col("mean_intensity") <= 255 * (1 - settings.audit_darkness_threshold))
    return _met(page_images.where(keep), pdf_pages, PAGE).where(_area(settings)).select(*PAGE, "seq", "rect", F.lit(IMAGE).alias("source"))


def annotation_candidates(annots: DataFrame) -> DataFrame:
    return annots.where("subtype = 'Redact'").select(*PAGE, "seq", "rect", F.lit(ANNOTATION).alias("source"))


def near_first(rects: np.ndarray, tolerance: float) -> np.ndarray:
    """Which rows of rects (x0, y0, x1, y1; in order) are kept: those that aren't near one kept before, by less than tolerance in all four.

    What is kept is looked up by cells as large as the tolerance, so a row meets the few kept ones near it instead of all.
    """
    keep = np.zeros(len(rects), bool)
    if tolerance <= 0:
        return ~keep
    kept: dict[tuple[int, int], list[int]] = {}
    cell = np.floor(rects[:, :2] / tolerance).tolist()
    rows = rects.tolist()
    for k, ((cx, cy), r) in enumerate(zip(cell, rows)):
        near = (j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in kept.get((cx + dx, cy + dy), ()))
        if not any(all(abs(p - q) < tolerance for p, q in zip(rows[j], r)) for j in near):
            keep[k] = True
            kept.setdefault((cx, cy), []).append(k)
    return keep


def dedupe(candidates: DataFrame, tolerance: float = DEFAULT.audit_dedupe_tolerance) -> DataFrame:
    """Candidates without those near an earlier one of the same page and source.

    First wins, and nearness isn't transitive, so a page's candidates are gone through in order; the size limit of files bounds them.
    """
    keys = [*PAGE, "source"]
    several = candidates.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    schema = candidates.select(*keys, "seq", "rect").schema

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        rect = t.column("rect").combine_chunks()
        sides = np.stack([rect.field(k).to_numpy(zero_copy_only=False) for k in ("x0", "y0", "x1", "y1")], 1)
        return t.filter(pa.array(near_first(sides, tolerance)))

    rows = candidates.select(*keys, "seq", "rect")
    return (_met(rows, several, keys, "left_anti")  # most pages have one candidate of a source
            .unionByName(_met(rows, several, keys, "left_semi").groupBy(*keys).applyInArrow(fold, schema)))


#: Boxes of a page that are held against each of its words; a page with more of them meets its words by cells.
FEW = 64


def text_under(boxes: DataFrame, words: DataFrame, spread: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """boxes with word_count, char_count (words joined by one space) and text of the words that overlap them.

    words: a row a word, or rows of whole pages that `spread` makes rows of words. They are shuffled as they come, once, by page, and
    spread when they have met their boxes; nothing but the words beneath boxes goes on. Where a page has more than FEW boxes,
    its words meet them by cell, so a page of very many of both isn't all its pairs.
    """
    keys = [*PAGE, "source", "seq"]
    own = boxes.select(*keys, F.col("rect").alias("box"), (F.count("*").over(Window.partitionBy(*PAGE)) > FEW).alias("crowded"))
    near = spread(_met(words, own.where("not crowded"), PAGE)).where(g.overlap(F.col("box"), F.col("rect"))).select(*keys, "word_seq", "word")
    full = own.where("crowded")
    there = spread(_met(words, full.select(*PAGE).distinct(), PAGE)).select(*PAGE, "word_seq", F.col("rect").alias("word_rect"), "word")
    far = g.overlapping(full.select(*keys, "box"), there, PAGE, "box", "word_rect").select(*keys, "word_seq", "word")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_seq", "word"))), lambda x: x["word"]), " ")
    joined = lambda hits: hits.groupBy(*keys).agg(text.alias("text"), F.count("*").alias("word_count")).withColumn("char_count", F.length("text"))
    return _met(boxes, joined(near).unionByName(joined(far)), keys, "left").select(
        *boxes.columns, F.coalesce("word_count", F.lit(0)).cast("int").alias("word_count"),
        F.coalesce("char_count", F.lit(0)).cast("int").alias("char_count"), "text")


def findings(candidates: DataFrame, words: DataFrame, settings: Settings = DEFAULT, spread: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """One row a finding: doc_id, page_number, rect, source, risk_level, word and char counts, note, source_order, seq. words, spread: of text_under."""
    found = text_under(dedupe(candidates, settings.audit_dedupe_tolerance), words, spread)
    annotation, critical = F.col("source") == ANNOTATION, (F.col("source") == ANNOTATION) | (F.col("char_count") > 0)
    counted = lambda c: F.when(critical, F.col(c)).otherwise(F.lit(0)).cast("int")
    return found.select(
        *PAGE, "rect", "source", F.when(critical, "critical").otherwise("clear").alias("risk_level"),
        counted("word_count").alias("underlying_word_count"), counted("char_count").alias("underlying_char_count"),
        F.when(annotation, NOTE_ANNOTATION).when(critical, NOTE_CRITICAL).otherwise(NOTE_CLEAR).alias("note"),
        F.array_position(F.array(*map(F.lit, (ANNOTATION, VECTOR, IMAGE))), F.col("source")).cast("int").alias("source_order"), "seq")


def report(found: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """One row a document: counts by risk level, pages audited, summary. Documents without findings are there too."""
    per = found.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("risk_level") == "critical").alias("critical"),
        F.count_if(F.col("risk_level") == "clear").alias("clear"), F.count_if(F.col("risk_level") == "unknown").alias("unknown"))
    pages = pdf_pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages_audited"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return _met(pages, per, ["doc_id"], "left").select(
        "doc_id", n("total").alias("total_boxes_found"), n("critical").alias("critical_count"), n("clear").alias("clear_count"),
        n("unknown").alias("unknown_count"), "pages_audited",
        F.when(n("critical") > 0, F.format_string(SUMMARY_CRITICAL, n("critical")))
        .when(n("total") > 0, F.format_string(SUMMARY_CLEAR, n("total"))).otherwise(SUMMARY_NONE).alias("summary"))


def reveal(candidates: DataFrame, words: DataFrame, doc_id: str, confirm_ownership: bool = False, settings: Settings = DEFAULT) -> DataFrame:
    """The text beneath the boxes of one document, for its owner's own remediation; never for many documents at once."""
    if confirm_ownership is not True:
        raise ValueError("reveal() needs confirm_ownership=True from the document's owner.")
    one = candidates.where(F.col("doc_id") == doc_id)
    found = text_under(dedupe(one, settings.audit_dedupe_tolerance), words.where(F.col("doc_id") == doc_id))
    return found.where("char_count > 0").select(*PAGE, "rect", "source", F.col("text").alias("revealed_text"))
