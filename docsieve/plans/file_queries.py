"""Queries that go through real file bytes: small PDFs and images are made from rows, then read, judged and changed.

What a file holds follows from its row's id, so SQL over the same rows gives the expected result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, revisions
from ..sources import files as fs
from ..sources import images as im
from ..storage import materialize
from . import api


def sample_pdf(content: bytes, saves: int = 0, root: bytes = b"", page: bytes = b"", resources: bytes = b"") -> bytes:
    """A PDF of one page, saved again `saves` times."""
    objs = {
        1: b"<</Type/Catalog/Pages 2 0 R" + root + b">>", 2: b"<</Type/Pages/Count 1/Kids[3 0 R]>>",
        3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F 4 0 R>>" + resources + b">>/Contents 5 0 R" + page + b">>",
        4: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", 5: b"<</Length %d>>stream\n%s\nendstream" % (len(content), content)}
    out, prev = bytearray(b"%PDF-1.4\n"), None
    for k in range(saves + 1):
        at = {}
        for n, o in (objs if k == 0 else {6: b"<</Producer(save %d)>>" % k}).items():
            at[n] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
        table = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in at.items())
        out += b"trailer\n<</Size 7/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (b"/Prev %d" % prev if prev else b"", table)
        out += b"\n" if k < saves else b""
        prev = table
    return bytes(out)


def _files(spark: SparkSession, sf_dir: str, make: Callable[[int], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(i) for i in b.column(0).to_pylist()], pa.binary())], ["doc_id", "content"])

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").mapInArrow(run, "doc_id long, content binary")


_TEXT = b"BT /F 12 Tf 72 700 Td (hidden words) Tj ET\n"
_BOX = (b"0 g 70 690 200 30 re f\n", b"0 g 70 300 200 30 re f\n", b"")


def pdf_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(i: int) -> bytes:
        kind = i % 8
        if kind < 3:
            return (b"", b"no file of any kind", b"%PDF-1.4 cut off, and nothing else follows that could be read as an object")[kind]
        if kind == 3:
            return sample_pdf(_TEXT, root=b"/X<</S/JavaScript>>")
        if kind == 4:
            return sample_pdf(_TEXT, root=b"/AA<</WC<</S/GoTo/Next<</S/Laun#63h>>>>>>")
        if kind == 5:
            return sample_pdf(_TEXT).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt<<>>")
        return sample_pdf(_TEXT) if kind == 6 else im.encode(np.full((4, 5, 3), i % 251, np.uint8), "PNG")

    out = api.validate(_files(spark, sf_dir, make))
    return out.select("doc_id", "kind", "page_count", F.regexp_replace("error", "PDF: .*", "PDF").alias("error"))


def pdf_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda i: b"/Annots[<</Subtype/Redact/Rect[70 690 270 720]>>]" if i % 5 == 0 else b""
    _, reports, _ = api.audit_redactions(_files(spark, sf_dir, lambda i: sample_pdf(_TEXT + _BOX[i % 3], page=page(i))))
    return reports


def pdf_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reports, _ = api.discover_revisions(_files(spark, sf_dir, lambda i: sample_pdf(_TEXT, saves=i % 4)))
    return reports


def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a border bar at even ids, with text beneath; what is left is read back."""
    content = lambda i: b"BT /F 12 Tf 5 400 Td (edge) Tj ET\n" + _TEXT + (b"0 g 0 0 40 792 re f\n" if i % 2 == 0 else b"")
    out = materialize(api.process(_files(spark, sf_dir, lambda i: sample_pdf(content(i))), vector_mode="redact"))  # read twice below
    words = fs.parse_pdfs(out.select("doc_id", F.col("output").alias("content"))).select("doc_id", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("words"))
    return out.select("doc_id", "kind", "pages_flagged", "error").join(words, "doc_id")


def image_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a bar at the left, at the top (inset), or none; bars are cropped off."""
    def make(i: int) -> bytes:
        a = np.full((60, 80, 3), 240, np.uint8)
        if i % 3 == 0:
            a[:, :8] = 5
        elif i % 3 == 1:
            a[:8, 8:72] = 5
        return im.encode(a, "PNG" if i % 2 else "TIFF")

    out = materialize(api.process(_files(spark, sf_dir, make), raster_mode="crop"))  # read twice below
    size = api.decode_images(out.select("doc_id", F.col("output").alias("content"))).select("doc_id", "height", "width")
    return out.select("doc_id", "kind", "pages_flagged", "output_format", "error").join(size, "doc_id")


_INK = b"[/Separation/Black/DeviceCMYK<</FunctionType 2/Domain[0 1]/C0[0 0 0 0]/C1[0 0 0 1]/N 1>>]"
_STEPS = (b"[/Separation/Spot/DeviceGray<</FunctionType 3/Domain[0 1]/Bounds[0.5]/Encode[0 1 0 1]/Functions[<</FunctionType 2/Domain[0 1]/C0[1]/C1[1]/N 1>>"
          b"<</FunctionType 2/Domain[0 1]/C0[1]/C1[0]/N 1>>]>>]")
_SPACES = (b"/ColorSpace<</Ink " + _INK + b"/Steps " + _STEPS + b"/Few[/Indexed/DeviceRGB 1<FFFFFF000000>]/Cie[/Lab<</WhitePoint[0.9505 1 1.089]>>]>>")
#: Fills of boxes; the even ones of each kind of space are dark.
_FILLS = (b"0 g", b"1 g", b"/Ink cs 1 scn", b"/Ink cs 0 scn", b"/Few cs 1 sc", b"/Few cs 0 sc", b"/Cie cs 5 0 0 sc", b"/Cie cs 95 0 0 sc", b"/Steps cs 0.95 scn", b"/Steps cs 0.5 scn")


def pdf_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of files whose box is filled in one of five colour spaces, over none to three words, on a page that is shown turned."""
    def make(i: int, n_chars: int, lang: str) -> bytes:
        words = b" ".join([lang.encode()] * (n_chars % 4))
        return sample_pdf(b"BT /F 12 Tf 72 700 Td (%s) Tj ET\n%s 70 690 200 30 re f\n" % (words, _FILLS[i % 10]), page=b"/Rotate %d" % (n_chars // 4 % 4 * 90), resources=_SPACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(*r) for r in rows], pa.binary())], ["doc_id", "content"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("lang", F.lit("")).alias("lang"))
    found, _, _ = api.audit_redactions(docs.mapInArrow(run, "doc_id long, content binary"))
    return found.select("doc_id", "source", "risk_level", "underlying_word_count", "underlying_char_count", *(F.round(F.col("rect")[c]).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))


QUERIES = {f.__name__: f for f in (pdf_guards, pdf_audit, pdf_colors, pdf_revisions, pdf_clean, image_clean)}

_q = lambda s: s.replace("'", "''")

ORACLES = {
    "pdf_guards": r"""
        SELECT doc_id, CASE WHEN doc_id % 8 < 2 THEN NULL WHEN doc_id % 8 = 7 THEN 'raster_image' ELSE 'pdf' END AS kind,
               CASE WHEN doc_id % 8 IN (6, 7) THEN 1 END::INT AS page_count,
               CASE doc_id % 8 WHEN 0 THEN 'Empty file.' WHEN 1 THEN 'Unrecognized or unsupported file type.' WHEN 2 THEN 'Malformed or corrupt PDF'
                 WHEN 3 THEN 'Document rejected: contains disallowed active content (/JavaScript).'
                 WHEN 4 THEN 'Document rejected: an additional-actions (/AA) trigger references disallowed action type(s) (Launch).'
                 WHEN 5 THEN 'Encrypted/password-protected PDFs are not supported.' END AS error
        FROM documents""",
    "pdf_audit": f"""
        SELECT doc_id, n AS total_boxes_found, bad AS critical_count, n - bad AS clear_count, 0 AS unknown_count, 1 AS pages_audited,
               CASE WHEN bad > 0 THEN replace('{_q(audit.SUMMARY_CRITICAL)}', '%d', bad::VARCHAR) WHEN n > 0 THEN replace('{_q(audit.SUMMARY_CLEAR)}', '%d', n::VARCHAR)
                    ELSE '{_q(audit.SUMMARY_NONE)}' END AS summary
        FROM (SELECT doc_id, (doc_id % 3 < 2)::INT + (doc_id % 5 = 0)::INT AS n, (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT AS bad FROM documents)""",
    "pdf_colors": """
        SELECT doc_id, 'vector_fill' AS source, CASE WHEN w > 0 THEN 'critical' ELSE 'clear' END AS risk_level, w AS underlying_word_count,
               CASE WHEN w > 0 THEN w * length(lang) + w - 1 ELSE 0 END::INT AS underlying_char_count,
               [70, 690, 342, 72][t] AS x0, [72, 70, 690, 342][t] AS y0, [270, 720, 542, 102][t] AS x1, [102, 270, 720, 542][t] AS y1
        FROM (SELECT doc_id, lang, (n_chars % 4)::INT AS w, n_chars // 4 % 4 + 1 AS t FROM documents WHERE doc_id % 2 = 0)""",
    "pdf_revisions": f"""
        SELECT doc_id, (1 + doc_id % 4)::INT AS total_revisions_found, 1 AS pages_in_current_revision,
               CASE WHEN doc_id % 4 > 0 THEN replace('{_q(revisions.SUMMARY_PRIOR)}', '%d', (doc_id % 4)::VARCHAR) ELSE '{_q(revisions.SUMMARY_NONE)}' END AS summary,
               false AS truncated FROM documents""",
    "pdf_clean": """
        SELECT doc_id, 'pdf' AS kind, (1 - doc_id % 2)::INT AS pages_flagged, NULL::VARCHAR AS error,
               CASE WHEN doc_id % 2 = 0 THEN 'hidden words' ELSE 'edge hidden words' END AS words FROM documents""",
    "image_clean": """
        SELECT doc_id, 'raster_image' AS kind, (doc_id % 3 < 2)::INT AS pages_flagged, 'tiff' AS output_format, NULL::VARCHAR AS error,
               CASE WHEN doc_id % 3 = 1 THEN 52 ELSE 60 END AS height, CASE WHEN doc_id % 3 = 0 THEN 72 ELSE 80 END AS width FROM documents""",
}
