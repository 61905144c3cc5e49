"""Whole operations on files: validate, clean, audit, find revisions. Files are rows (doc_id, content).

A document that fails is a row with an error; nothing of it reaches later stages, and no job fails for it.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes_ops as b
from ..functions import pixels
from ..operators import actions, audit, graphs, raster, revisions, saves, vector
from ..settings import DEFAULT, Settings
from ..sources import files as fs
from ..sources import images as im
from ..sources import pdf_saves
from ..sources import pdf_writer as writer
from ..storage import folder_for_files, materialize, write_file

log = logging.getLogger(__name__)

ERROR_PDF_ONLY = "Only PDF documents are supported for this operation."
NOTE_SMALL = "Slice too small to be a real revision — likely a coincidental byte match."
NOTE_UNPARSED = "Could not be parsed as a standalone PDF, even in recovery mode."
NOTE_RECOVERED = "Opened via recovery mode — trailing structure was imperfect but content was readable."


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def guards(files: DataFrame, settings: Settings = DEFAULT, pdf_only: bool = False) -> DataFrame:
    """files with kind and the first error of size, kind and forbidden tokens; only built-in functions, before anything is opened."""
    content = F.col("content")
    kind = b.kind_of(content)
    tokens = F.when(kind == "pdf", b.token_error(b.forbidden_tokens(b.latin1(content))))
    wrong = F.when(kind.isNull(), b.ERROR_KIND)
    if pdf_only:
        wrong = F.coalesce(wrong, F.when(kind != "pdf", ERROR_PDF_ONLY))
    length = F.coalesce(F.octet_length(content), F.lit(0))
    return files.select("doc_id", "content", kind.alias("kind"), F.coalesce(b.size_error(length, settings), wrong, tokens).alias("error"))


def _sanitize_image(raw: bytes, settings: Settings) -> tuple[bytes | None, str | None]:
    """(rebuilt bytes, error)."""
    try:
        fmt, w, h = im.dimensions(raw)
        if max(w, h) > settings.max_image_dimension:
            return None, f"Image dimensions exceed the {settings.max_image_dimension}px per-side limit."
        if w * h > settings.max_image_pixels:
            return None, "Image pixel count exceeds safe processing limits."
        if fmt == "JPEG":  # its pixels stay as they are coded
            return im.bare_jpeg(raw), None
        bgr, _ = im.decode(raw, alpha=True)
        return im.encode(bgr, "PNG" if fmt == "PNG" and raw[25] in (3, 4, 6) else "TIFF"), None
    except im.ImageError as e:
        return None, f"Malformed or corrupt image: {e}"


def _facts(raw: bytes, settings: Settings, rebuild: bool) -> tuple[int | None, int | None, list[str], bytes | None, str | None]:
    """(pages, objects, action types behind triggers, rebuilt bytes, error) of a PDF; past a limit nothing more is read."""
    doc, error = fs.open_any(raw)
    if doc is None:
        return None, None, [], None, error
    n_objects, n_pages = doc.n_objects(), len(doc.pages())
    if n_objects > settings.max_pdf_objects or n_pages > settings.max_pdf_pages:
        return n_pages, n_objects, [], None, None
    return n_pages, n_objects, [a["subtype"] for a in doc.actions()], writer.rebuild(doc) if rebuild and n_pages else None, None


def screened(settings: Settings = DEFAULT, empty: bool = True) -> Column:
    """The first error of a PDF with the columns error, n_objects, n_pages and subtypes: what reading gave, limits, actions, no pages."""
    return F.coalesce(
        "error", F.when(F.col("n_objects") > settings.max_pdf_objects, fs.ERROR_OBJECTS), F.when(F.col("n_pages") > settings.max_pdf_pages, fs.ERROR_PAGES),
        actions.error(actions.dangerous(F.col("subtypes"))), F.when(F.col("n_pages") == 0, fs.ERROR_NO_PAGES) if empty else F.lit(None).cast("string"))


def validate(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """doc_id, kind, page_count, sanitized (rebuilt bytes), error.

    Tasks turn bytes into facts and rebuilt bytes; which facts refuse a document, and which of several errors it gets, are expressions.
    """
    checked = guards(files, settings)

    def make(doc_id, content: bytes, kind: str) -> Iterable[tuple]:
        try:
            if kind == "raster_image":
                out, error = _sanitize_image(content, settings)
                facts = (1, None, [], out, error)
            else:
                facts = _facts(content, settings, True)
        except Exception:  # noqa: BLE001 - one bad document must not end a job
            facts = (None, None, [], None, fs.ERROR_INTERNAL)
        yield doc_id, kind, *facts

    run = fs.by_row(make, {"doc_id": None, "kind": pa.string(), "n_pages": pa.int32(), "n_objects": pa.int32(), "subtypes": pa.list_(pa.string()),
                           "sanitized": pa.binary(), "error": pa.string()}, limit=settings.processing_timeout_seconds)
    facts = checked.where(F.col("error").isNull()).select("doc_id", "content", "kind").mapInArrow(
        run, f"doc_id {_kind(files)}, kind string, n_pages int, n_objects int, subtypes array<string>, sanitized binary, error string")
    fine = lambda c, name: F.when(F.col("verdict").isNull(), F.col(c)).alias(name)
    good = facts.withColumn("verdict", screened(settings)).select("doc_id", "kind", fine("n_pages", "page_count"), fine("sanitized", "sanitized"), F.col("verdict").alias("error"))
    bad = checked.where(F.col("error").isNotNull()).select(
        "doc_id", "kind", F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("binary").alias("sanitized"), "error")
    return good.unionByName(bad)


# ---- audit ----------------------------------------------------------------------------------------------------------------------


def _candidates(rel: dict[str, DataFrame], settings: Settings) -> DataFrame:
    return (audit.annotation_candidates(rel["annots"]).unionByName(audit.vector_candidates(rel["drawings"], rel["pages"], settings))
            .unionByName(audit.image_candidates(rel["page_images"], rel["pages"], settings)))


def audit_redactions(files: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, reports, errors) of the sanitised documents. Findings never hold the text that was found."""
    validated = validate(files, settings)
    pdfs = validated.where("error is null and kind = 'pdf'").select("doc_id", F.col("sanitized").alias("content"))
    parsed = materialize(fs.parse_pdfs(pdfs, settings))
    rel = fs.relations(parsed.where("error is null"))
    found = audit.findings(materialize(_candidates(rel, settings)), rel["words"], settings)  # read several times there
    errors = (validated.select("doc_id", F.coalesce("error", F.when(F.col("kind") != "pdf", F.lit(
        "Redaction audit only supports PDF documents (no text layer exists to check in a raster image)."))).alias("error"))
        .unionByName(parsed.select("doc_id", "error")).where("error is not null"))
    return found, audit.report(found, rel["pages"]), errors


def reveal_text(files: DataFrame, doc_id, confirm_ownership: bool = False, settings: Settings = DEFAULT) -> DataFrame:
    """The text beneath the boxes of one document; see operators.audit.reveal."""
    one = fs.parse_pdfs(validate(files.where(F.col("doc_id") == doc_id), settings).where("error is null and kind = 'pdf'").select(
        "doc_id", F.col("sanitized").alias("content")), settings)
    rel = fs.relations(one.where("error is null"))
    out = audit.reveal(_candidates(rel, settings), rel["words"], doc_id, confirm_ownership, settings)
    log.warning("text beneath redaction boxes of %s was revealed to its owner", doc_id)
    return out


# ---- revisions ------------------------------------------------------------------------------------------------------------------


def inspect_slice(raw: bytes, settings: Settings = DEFAULT) -> dict:
    """Whether a prefix of a file is a PDF by itself, and what it counts; never raises."""
    out = {"openable": False, "page_count": None, "object_count": None, "creation_date": None, "mod_date": None, "note": ""}
    if len(raw) < settings.forensics_min_revision_bytes:
        return out | {"note": NOTE_SMALL}
    try:
        doc, recovered = fs.Document.open(raw)
    except Exception:  # noqa: BLE001
        return out | {"note": NOTE_UNPARSED}
    try:
        created, modified = doc.info()
        return {"openable": True, "page_count": len(doc.pages()), "object_count": doc.n_objects(), "creation_date": created,
                "mod_date": modified, "note": NOTE_RECOVERED if recovered else ""}
    except Exception:  # noqa: BLE001
        return out | {"openable": True, "note": "Opened but metadata could not be fully read."}


_SLICE = "struct<openable:boolean,page_count:int,object_count:int,creation_date:string,mod_date:string,note:string>"


_SAVES = {"saves": "struct<save:int,root:bigint,creation_date:string,mod_date:string,locked:boolean>", "changes": "struct<save:int,object:bigint,alive:boolean>",
          "nodes": "struct<save:int,object:bigint,leaves:int,kids:array<bigint>>"}
_SAVE_TYPES = {
    "saves": pa.struct([("save", pa.int32()), ("root", pa.int64()), ("creation_date", pa.string()), ("mod_date", pa.string()), ("locked", pa.bool_())]),
    "changes": pa.struct([("save", pa.int32()), ("object", pa.int64()), ("alive", pa.bool_())]),
    "nodes": pa.struct([("save", pa.int32()), ("object", pa.int64()), ("leaves", pa.int32()), ("kids", pa.list_(pa.int64()))])}


def read_saves(raw: bytes, offsets: list[int], settings: Settings = DEFAULT) -> tuple[dict, list[dict]]:
    """(rows of all saves from one parse, slices). A file whose saves don't build on each other plainly has no rows, but every slice opened by itself."""
    small = sum(end < settings.forensics_min_revision_bytes for end in offsets)
    try:
        rows = pdf_saves.read_saves(raw, offsets[small:])
    except Exception:  # noqa: BLE001
        return {k: [] for k in _SAVES}, [inspect_slice(raw[:end], settings) for end in offsets]
    named = {k: [dict(zip([f.name for f in _SAVE_TYPES[k]], row)) for row in v] for k, v in rows.items()}
    return named, [inspect_slice(raw[:end], settings) for end in offsets[:small]]


def save_relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """saves, changes and nodes of operators.saves, a row each."""
    return {k: parsed.select("doc_id", F.explode(k).alias("r")).select("doc_id", "r.*") for k in _SAVES}


def discover_revisions(files: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(revisions, reports, errors) of the files as they came: a rebuild would merge their saves.

    A file is parsed once; what each of its saves holds follows from the rows of its tables (operators.saves).
    """
    checked = guards(files, settings, pdf_only=True)
    errors = checked.where("error is not null").select("doc_id", "error")
    good = checked.where("error is null").select("doc_id", "content")
    most = settings.forensics_max_revisions_reported
    kind = pa.list_(pa.struct([("openable", pa.bool_()), ("page_count", pa.int32()), ("object_count", pa.int32()), ("creation_date", pa.string()),
                               ("mod_date", pa.string()), ("note", pa.string())]))

    def make(doc_id, raw: bytes, offsets: list[int]) -> Iterable[tuple]:
        try:
            n_pages, n_objects, subtypes, _, error = _facts(raw, settings, False)
        except Exception:  # noqa: BLE001
            n_pages, n_objects, subtypes, error = None, None, [], "An internal discovery error occurred."
        rows, slices = ({k: [] for k in _SAVES}, []) if error else read_saves(raw, offsets[:most], settings)
        yield doc_id, offsets, len(raw), slices, *rows.values(), n_pages, n_objects, subtypes, error

    run = fs.by_row(make, {"doc_id": None, "offsets": pa.list_(pa.int64()), "length": pa.int64(), "slices": kind,
                           **{k: pa.list_(t) for k, t in _SAVE_TYPES.items()}, "n_pages": pa.int32(), "n_objects": pa.int32(),
                           "subtypes": pa.list_(pa.string()), "error": pa.string()}, rows=64,
                    limit=settings.processing_timeout_seconds, late="Discovery exceeded the allotted time limit.")
    seen = good.select(
        "doc_id", "content", b.boundary_offsets(b.latin1(F.col("content")), most=settings.forensics_max_boundary_candidates).alias("offsets"))
    schema = ", ".join(f"{k} array<{t}>" for k, t in _SAVES.items())
    parsed = materialize(seen.mapInArrow(run, f"doc_id {_kind(files)}, offsets array<long>, length long, slices array<{_SLICE}>, {schema}, "
                                             "n_pages int, n_objects int, subtypes array<string>, error string").withColumn(
        "error", screened(settings, empty=False)))  # structure limits and dangerous actions refuse a document here too
    fine = parsed.where("error is null")
    opened = fine.select("doc_id", F.posexplode("slices").alias("pos", "s")).select("doc_id", (F.col("pos") + 1).alias("revision_index"), "s.*")
    rel, small = save_relations(fine), fine.select("doc_id", F.size("slices").alias("small"))
    counted = (rel["saves"].join(saves.object_counts(rel["changes"], rel["saves"]), ["doc_id", "save"])
               .join(saves.page_counts(rel["nodes"], rel["saves"]), ["doc_id", "save"]).join(small, "doc_id"))
    free = lambda c: F.when(~F.col("locked"), F.col(c)).alias(c)
    derived = counted.select(
        "doc_id", (F.col("small") + F.col("save") + 1).alias("revision_index"), (~F.col("locked")).alias("openable"),
        *map(free, ("page_count", "object_count", "creation_date", "mod_date")), F.when(F.col("locked"), NOTE_UNPARSED).otherwise("").alias("note"))
    revs = revisions.revisions(fine.select("doc_id", "length", "offsets"), settings).join(opened.unionByName(derived), ["doc_id", "revision_index"])
    return revs, revisions.report(revs, fine.select("doc_id", "length", "offsets"), settings), errors.unionByName(
        parsed.where("error is not null").select("doc_id", "error"))


def object_graph(files: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(reports, unreachable objects) of the object graphs of PDFs (operators.graphs.report); documents that can't be read have an error."""
    link = pa.struct([("source", pa.int64()), ("target", pa.int64())])

    def make(doc_id, raw: bytes | None) -> Iterable[tuple]:
        doc, _, error = fs.open_pdf(raw or b"", settings)
        if doc is None:
            yield doc_id, [], [], error
        else:
            objects, links = pdf_saves.object_links(doc)
            yield doc_id, objects, [dict(zip(("source", "target"), x)) for x in links], None

    run = fs.by_row(make, {"doc_id": None, "objects": pa.list_(pa.int64()), "links": pa.list_(link), "error": pa.string()}, rows=64, limit=settings.processing_timeout_seconds)
    parsed = materialize(files.select("doc_id", "content").mapInArrow(
        run, f"doc_id {_kind(files)}, objects array<long>, links array<struct<source:bigint,target:bigint>>, error string"))
    reports, dropped = graphs.report(parsed.select("doc_id", F.explode("objects").alias("object")),
                                     parsed.select("doc_id", F.explode("links").alias("r")).select("doc_id", "r.*"), settings)
    failed = parsed.where("error is not null").select("doc_id", "error")
    return reports.unionByName(failed, allowMissingColumns=True), dropped


EXTRACTIONS = "doc_id string, revision_index int, event string, bytes bigint, error string, at timestamp"


def _record(files: DataFrame, audit_table: str | None, doc_id, index: int, event: str, size: int | None = None, error: str | None = None) -> None:
    log.warning("extraction of revision %s of %s: %s%s", index, doc_id, event, "" if size is None else f", {size} bytes")
    if audit_table:
        row = files.sparkSession.createDataFrame([(str(doc_id), index, event, size, error)], "doc_id string, revision_index int, event string, bytes bigint, error string")
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(audit_table)


def extractions(spark: SparkSession, audit_table: str) -> DataFrame:
    """One row a call of extract_revision with audit_table: doc_id, revision_index, requested_at, then of its end, if it had one, outcome, bytes, error."""
    rows = spark.read.schema(EXTRACTIONS).parquet(audit_table)
    own = Window.partitionBy("doc_id", "revision_index").orderBy("at")
    ends = F.struct("event", "bytes", "error")
    paired = rows.withColumn("end", F.lead(ends).over(own)).where("event = 'requested'")
    ended = F.col("end.event") != "requested"
    return paired.select("doc_id", "revision_index", F.col("at").alias("requested_at"),
                         *(F.when(ended, F.col(f"end.{c}")).alias(n) for c, n in (("event", "outcome"), ("bytes", "bytes"), ("error", "error"))))


def extract_revision(files: DataFrame, doc_id, revision_index: int = 1, confirm_ownership: bool = False, settings: Settings = DEFAULT,
                     audit_table: str | None = None) -> bytes:
    """The sanitised bytes of one earlier save of one document, for its owner. There is no way to ask for many.

    Every call is logged, and with `audit_table` recorded in that Parquet folder before anything is read and when it ends.
    """
    if confirm_ownership is not True:
        raise ValueError("extract_revision() requires confirm_ownership=True — this call must originate from an explicit, owner-confirmed "
                         "action, never a default or automatic one.")
    _record(files, audit_table, doc_id, revision_index, "requested")
    try:
        out = _extracted(files, doc_id, revision_index, settings)
    except Exception as e:
        _record(files, audit_table, doc_id, revision_index, "refused" if isinstance(e, ValueError) else "failed", error=str(e) if isinstance(e, ValueError) else None)
        raise
    _record(files, audit_table, doc_id, revision_index, "completed", len(out))
    return out


def _extracted(files: DataFrame, doc_id, revision_index: int, settings: Settings) -> bytes:
    bounds = revisions.boundaries(files.where(F.col("doc_id") == doc_id), settings)
    row = bounds.first()
    offsets = row["offsets"] if row else []
    if not 1 <= revision_index <= len(offsets):
        raise ValueError(f"revision_index {revision_index} is out of range (found {len(offsets)} revision(s)).")
    part = files.where(F.col("doc_id") == doc_id).select(
        "doc_id", F.substring("content", F.lit(1), F.lit(int(offsets[revision_index - 1]))).alias("content"))
    out = validate(part, settings).first()
    if out["error"]:
        raise ValueError(f"Historical revision failed exploit screening and cannot be released: {out['error']}")
    return bytes(out["sanitized"])


# ---- cleaning -------------------------------------------------------------------------------------------------------------------


def clean_pdfs(pdfs: DataFrame, mode: str | None = None, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(outputs, flagged shapes) of sanitised PDFs (doc_id, content). mode 'redact' also takes out the text beneath; all else masks."""
    mode = mode or settings.vector_default_mode
    parsed = materialize(fs.parse_pdfs(pdfs, settings))
    rel = fs.relations(parsed.where("error is null"))
    shapes = vector.border_shapes(rel["drawings"], rel["pages"], settings)
    colors = vector.background_colors(shapes, rel["drawings"], rel["pages"])
    edits = (shapes.join(colors, vector.PAGE).groupBy("doc_id").agg(
        F.collect_list(F.struct("page_number", "rect", "background")).alias("edits"), F.countDistinct("page_number").cast("int").alias("pages_flagged")))
    joined = pdfs.join(parsed.select("doc_id", "error"), "doc_id").join(edits, "doc_id", "left").select("doc_id", "content", "edits", "pages_flagged", "error")

    def make(doc_id, content: bytes, edits: list[dict] | None, flagged: int | None, error: str | None) -> Iterable[tuple]:
        change, out, began = writer.redacted if mode == "redact" else writer.masked, None, time.monotonic()
        if error is None:
            try:
                doc, _ = fs.Document.open(content)
                pages, by_page = doc.pages(), {}
                for e in edits or []:
                    by_page.setdefault(e["page_number"], []).append((tuple(e["rect"][c] for c in ("x0", "y0", "x1", "y1")), e["background"]))
                out = writer.rebuild(doc, {n: change(doc, pages[n], [r for r, _ in es], es[0][1]) for n, es in by_page.items()})
            except Exception:  # noqa: BLE001
                error = fs.ERROR_INTERNAL
        yield doc_id, out, flagged or 0, time.monotonic() - began, error

    run = fs.by_row(make, {"doc_id": None, "output": pa.binary(), "pages_flagged": pa.int32(), "elapsed_seconds": pa.float64(), "error": pa.string()},
                    limit=settings.processing_timeout_seconds)
    out = joined.mapInArrow(run, f"doc_id {_kind(pdfs)}, output binary, pages_flagged int, elapsed_seconds double, error string")
    return out.withColumn("output_format", F.lit("pdf")), shapes


_PIXELS = "height int, width int, channels int, data binary, format string, original binary, error string"


def decode_images(images: DataFrame) -> DataFrame:
    """doc_id, height, width, channels, data, format, original, error of image bytes (doc_id, content), as the image source gives them.

    original: the bytes, of those formats that can't be written again as they were.
    """
    def make(doc_id, content: bytes) -> Iterable[tuple]:
        try:
            bgr, fmt = im.decode(content)
            yield doc_id, *bgr.shape, bgr.tobytes(), fmt, content if im.has_alpha(content) else None, None
        except im.ImageError as e:
            yield doc_id, None, None, None, None, None, None, f"Malformed or corrupt image: {e}"

    run = fs.by_row(make, {"doc_id": None, "height": pa.int32(), "width": pa.int32(), "channels": pa.int32(), "data": pa.binary(), "format": pa.string(),
                           "original": pa.binary(), "error": pa.string()})
    jpeg = F.coalesce(F.col("content").startswith(F.unhex(F.lit("FFD8FF"))), F.lit(False))
    other = images.where(~jpeg).select("doc_id", "content").mapInArrow(run, f"doc_id {_kind(images)}, {_PIXELS}")
    return other.unionByName(_decode_jpegs(images.where(jpeg)))


def _decode_jpegs(images: DataFrame) -> DataFrame:
    """As decode_images: the bytes go to files of the shared folder, one for each content, which Spark's image source reads."""
    names, (folder, uri) = F.sha2("content", 256), folder_for_files(images.sparkSession)

    def make(doc_id, content: bytes, name: str) -> Iterable[tuple]:
        write_file(uri, name + ".jpg", content)
        yield doc_id, content, name

    run = fs.by_row(make, {"doc_id": None, "original": pa.binary(), "name": pa.string()})
    kept = materialize(images.select("doc_id", "content", names).mapInArrow(run, f"doc_id {_kind(images)}, original binary, name string"))
    pixel = fs.read_pixels(images.sparkSession, folder, valid=False).withColumn("name", F.regexp_extract("doc_id", r"([0-9a-f]{64})\.jpg$", 1)).drop("doc_id")
    good = F.coalesce(F.col("height") > 0, F.lit(False))
    of = lambda c: F.when(good, F.col(c)).alias(c)
    return kept.join(pixel, "name", "left").select(
        "doc_id", *map(of, ("height", "width", "channels", "data")), F.when(good, "JPEG").alias("format"), of("original"),
        F.when(~good, "Malformed or corrupt image: its pixels can't be decoded").alias("error"))


def components_of(images: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Dark components of decoded images: the rows that operators.raster judges."""
    kinds = {"x": pa.int32(), "y": pa.int32(), "w": pa.int32(), "h": pa.int32(), "img_w": pa.int32(), "img_h": pa.int32(), "mean_intensity": pa.float64(), "edge_fraction": pa.float64()}

    def make(doc_id, h: int, w: int, c: int, data: bytes) -> Iterable[tuple]:
        return [(doc_id, *(r[n] for n in kinds)) for r in pixels.dark_components(pixels.to_bgr(data, h, w, c), settings)]

    run = fs.by_row(make, {"doc_id": None, **kinds})
    return images.select("doc_id", "height", "width", "channels", "data").mapInArrow(
        run, f"doc_id {_kind(images)}, x int, y int, w int, h int, img_w int, img_h int, mean_intensity double, edge_fraction double")


def clean_images(images: DataFrame, mode: str | None = None, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(outputs, flagged bands) of decoded images (doc_id, height, width, channels, data, format). mode 'crop'; all else paints.

    Images without bands come back as the bytes in the column `original`, where there are any. What is changed is written without
    alpha, and as PNG where it was a JPEG.
    """
    images = images if "original" in images.columns else images.withColumn("original", F.lit(None).cast("binary"))
    mode = mode or settings.raster_default_mode
    bands = raster.merge_by_side(raster.border_components(components_of(images, settings), settings))
    per = bands.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("side_order", "x", "y", "w", "h", "side"))).alias("bands"))
    joined = images.join(per, "doc_id", "left").select("doc_id", "height", "width", "channels", "data", "format", "original", "bands")

    def make(doc_id, h: int, w: int, c: int, data: bytes, fmt: str, original: bytes | None, found: list[dict] | None) -> Iterable[tuple]:
        if not found and original is not None:
            yield doc_id, original, 0, 0.0, fmt.lower()
            return
        bgr, began = pixels.to_bgr(data, h, w, c), time.monotonic()
        if found:
            bgr = pixels.crop(bgr, found) if mode == "crop" else pixels.paint(bgr, found)
        fmt = fmt if fmt in ("PNG", "TIFF") else "PNG"
        yield doc_id, im.encode(np.asarray(bgr), fmt), int(bool(found)), time.monotonic() - began, fmt.lower()

    run = fs.by_row(make, {"doc_id": None, "output": pa.binary(), "pages_flagged": pa.int32(), "elapsed_seconds": pa.float64(), "output_format": pa.string()})
    out = joined.mapInArrow(run, f"doc_id {_kind(images)}, output binary, pages_flagged int, elapsed_seconds double, output_format string")
    return out, bands


def process(files: DataFrame, vector_mode: str | None = None, raster_mode: str | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Validate and clean files of any kind: doc_id, kind, output, output_format, pages_flagged, elapsed_seconds (3 places), error."""
    validated = materialize(validate(files, settings))
    good = lambda kind: validated.where((F.col("kind") == kind) & F.col("error").isNull()).select("doc_id", F.col("sanitized").alias("content"))
    pdf_out, _ = clean_pdfs(good("pdf"), vector_mode, settings)
    decoded = materialize(decode_images(good("raster_image")))
    image_out, _ = clean_images(decoded.where("error is null"), raster_mode, settings)
    none: Column = F.lit(None)
    cols = lambda df, kind, error: df.select("doc_id", F.lit(kind).alias("kind") if kind else "kind", "output", "output_format", "pages_flagged",
                                             F.round("elapsed_seconds", 3).alias("elapsed_seconds"), error.alias("error"))
    failed = lambda df, kind: cols(df.withColumns({
        "output": none.cast("binary"), "output_format": none.cast("string"), "pages_flagged": none.cast("int"), "elapsed_seconds": none.cast("double")}), kind, F.col("error"))
    return (cols(pdf_out, "pdf", F.col("error")).unionByName(cols(image_out, "raster_image", none.cast("string")))
            .unionByName(failed(validated.where("error is not null"), None)).unionByName(failed(decoded.where("error is not null"), "raster_image")))
