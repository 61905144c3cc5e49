"""Files as DataFrames, and PDFs as relations."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings
from .pdf import Document, EncryptedError, Painter, PdfError, turned

ERROR_ENCRYPTED = "Encrypted/password-protected PDFs are not supported."
ERROR_OBJECTS = "Document object graph exceeds safe processing limits."
ERROR_PAGES = "Document exceeds maximum supported page count."
ERROR_NO_PAGES = "PDF contains no pages."
ERROR_INTERNAL = "An internal processing error occurred."
ERROR_LIMIT = "Processing exceeded the allotted time limit."


def read_files(spark: SparkSession, path: str, settings: Settings = DEFAULT, oversized: bool = True) -> DataFrame:
    """doc_id (the path), content, length, arrived. oversized=False leaves out files past the limit before their content is read."""
    files = spark.read.format("binaryFile").load(path)
    if not oversized:
        files = files.where((F.col("length") > 0) & (F.col("length") <= settings.max_upload_bytes))
    return files.select(F.col("path").alias("doc_id"), "content", "length", F.col("modificationTime").alias("arrived"))


def read_pixels(spark: SparkSession, path: str, valid: bool = True) -> DataFrame:
    """doc_id (the path), height, width, channels, data of PNG, TIFF and JPEG files, decoded by Spark; valid=False: -1 for a broken file's."""
    image = F.col("image")
    return spark.read.format("image").option("dropInvalid", valid).load(path).select(
        image["origin"].alias("doc_id"), image["height"].alias("height"), image["width"].alias("width"), image["nChannels"].alias("channels"), image["data"].alias("data"))


class _Late(BaseException):
    """A row takes too long; no Exception, so that no handler on the way takes it for a fault of the document."""


@contextmanager
def time_limit(seconds: float | None) -> Iterator[None]:
    """_Late where what is inside takes longer; a worker runs it in its main thread, elsewhere there is no limit."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise _Late

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def by_row(make: Callable[..., Iterable[tuple]], types: dict[str, pa.DataType | None], rows: int = 512, size: int = 8_000_000,
           limit: float | None = None, late: str = ERROR_LIMIT) -> Callable:
    """For mapInArrow: the rows that make(*values of a row) gives, in batches of at most `rows` rows and about `size` bytes.

    types: names and types of what is made; None for the type of the first column that comes in. limit: seconds for a row, past which it
    is given up and becomes one row with the error `late`, so a document that never ends costs its time and nothing else.
    """
    def made(values: tuple) -> list[tuple]:
        try:
            with time_limit(limit):
                return list(make(*values))
        except _Late:
            none = lambda t: [] if t is not None and pa.types.is_list(t) else None
            return [tuple(values[0] if t is None else late if name == "error" else none(t) for name, t in types.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, first = [], 0, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, first if t is None else t) for c, t in zip(zip(*out), types.values())], list(types))

        for b in batches:
            first = b.column(0).type
            for values in zip(*b.columns):  # a value is taken out of Arrow when its turn comes
                for row in made(tuple(v.as_py() for v in values)):
                    out.append(row)
                    held += sum(len(v) for v in row if isinstance(v, bytes | str))
                    if len(out) >= rows or held >= size:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    return run


_RECT = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])
_CLIPS = pa.list_(pa.struct([("even_odd", pa.bool_()), ("path", pa.list_(pa.float64()))]))
_PARTS = {
    "pages": [("page_number", pa.int32()), ("page_rect", _RECT)],
    "drawings": [("page_number", pa.int32()), ("seq", pa.int32()), ("rect", _RECT), ("fill", pa.list_(pa.float64())), ("fill_opacity", pa.float64()),
                 ("even_odd", pa.bool_()), ("path", pa.list_(pa.float64())), ("clips", _CLIPS)],
    "words": [("page_number", pa.int32()), ("word_seq", pa.int32()), ("rect", _RECT), ("word", pa.string())],
    "page_images": [("page_number", pa.int32()), ("seq", pa.int32()), ("rect", _RECT), ("n_channels", pa.int32()), ("variance", pa.float64()), ("mean_intensity", pa.float64())],
    "annots": [("page_number", pa.int32()), ("seq", pa.int32()), ("subtype", pa.string()), ("rect", _RECT)],
    "actions": [("origin", pa.string()), ("action_id", pa.int64()), ("parent_id", pa.int64()), ("subtype", pa.string())],
}
_SQL = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string",
        _RECT: "struct<x0:double,y0:double,x1:double,y1:double>", pa.list_(pa.float64()): "array<double>", pa.bool_(): "boolean",
        _CLIPS: "array<struct<even_odd:boolean,path:array<double>>>"}
_HEAD = [("error", pa.string()), ("n_pages", pa.int32()), ("n_objects", pa.int32()), ("recovered", pa.bool_()), ("creation_date", pa.string()), ("mod_date", pa.string())]


def _rect(r: tuple) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, r)))


def _opened(raw: bytes) -> tuple[Document | None, bool, str | None]:
    try:
        return *Document.open(raw), None
    except EncryptedError:
        return None, False, ERROR_ENCRYPTED
    except PdfError as e:
        return None, False, f"Malformed or corrupt PDF: {e}"
    except Exception:  # noqa: BLE001 - one bad document must not end a job
        return None, False, ERROR_INTERNAL


def open_any(raw: bytes) -> tuple[Document | None, str | None]:
    """(document, error), whatever the document's size."""
    doc, _, error = _opened(raw)
    return doc, error


def open_pdf(raw: bytes, settings: Settings = DEFAULT) -> tuple[Document | None, bool, str | None]:
    """(document, recovered, error); a document past a limit is an error."""
    doc, recovered, error = _opened(raw)
    if doc is not None and doc.n_objects() > settings.max_pdf_objects:
        return None, recovered, ERROR_OBJECTS
    if doc is not None and len(doc.pages()) > settings.max_pdf_pages:
        return None, recovered, ERROR_PAGES
    return doc, recovered, error


def page_rows(doc: Document, number: int, page: dict) -> dict[str, list[dict]]:
    """The rows of one page: page, drawings, words, page_images, annots."""
    painter, here = Painter(doc, page), {"page_number": number}
    x, low, right, top = doc.box(page)
    turns, annots = doc.rotation(page), []
    for k, annot in enumerate(map(doc.get, doc.get(page.get("Annots")) or [])):
        if isinstance(annot, dict) and isinstance(r := doc.get(annot.get("Rect")), list) and len(r) == 4:
            a, b, c, d = (float(doc.get(v)) for v in r)
            annots.append({**here, "seq": k, "subtype": str(doc.get(annot.get("Subtype")) or ""),
                           "rect": _rect(turned((min(a, c) - x, top - max(b, d), max(a, c) - x, top - min(b, d)), turns, right - x, top - low))})
    return {
        "pages": [{**here, "page_rect": _rect((0, 0, *painter.size))}],
        "drawings": [{**here, **d, "rect": _rect(d["rect"]), "fill": None if d["fill"] is None else list(d["fill"])} for d in painter.drawings],
        "words": [{**here, "word_seq": k, "rect": _rect(w["rect"]), "word": w["word"]} for k, w in enumerate(painter.words)],
        "page_images": [{**here, **i, "rect": _rect(i["rect"])} for i in painter.images], "annots": annots}


def parse_one(raw: bytes, settings: Settings = DEFAULT) -> dict:
    """The relations of one document as lists of rows; a document that can't be read in full has an error and no rows."""
    doc, recovered, error = open_pdf(raw, settings)
    out: dict = {k: [] for k in _PARTS} | {"error": error, "n_pages": None, "n_objects": None, "recovered": recovered, "creation_date": None, "mod_date": None}
    if doc is None:
        return out
    rows: dict = {k: [] for k in _PARTS}
    try:
        for number, page in enumerate(doc.pages()):
            for name, found in page_rows(doc, number, page).items():
                rows[name] += found
        rows["actions"] = doc.actions()
        created, modified = doc.info()
        return out | rows | {"n_pages": len(rows["pages"]), "n_objects": doc.n_objects(), "creation_date": created, "mod_date": modified}
    except PdfError as e:
        return out | {"error": f"Malformed or corrupt PDF: {e}"}
    except Exception:  # noqa: BLE001
        return out | {"error": ERROR_INTERNAL}


def parse_pdfs(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row a PDF of files (doc_id, content): error, counts, dates, and the relations as arrays. The content stays behind."""
    kind = files.schema["doc_id"].dataType.simpleString()
    types = {k: pa.list_(pa.struct(v)) for k, v in _PARTS.items()}

    def make(doc_id, content: bytes | None) -> Iterable[tuple]:
        row = parse_one(content or b"", settings)
        yield (doc_id, *(row[n] for n, _ in _HEAD), *(row[n] for n in types))

    run = by_row(make, {"doc_id": None, **dict(_HEAD), **types}, rows=64, limit=settings.processing_timeout_seconds)
    head = ", ".join(f"{n} {_SQL[t]}" for n, t in _HEAD)
    parts = ", ".join(f"{n} array<struct<{','.join(f'{f}:{_SQL[t]}' for f, t in v)}>>" for n, v in _PARTS.items())
    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, {head}, {parts}")


def relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """pages, drawings, words, page_images, annots and actions of all documents, a row each."""
    return {name: parsed.select("doc_id", F.explode(name).alias("r")).select("doc_id", "r.*") for name in _PARTS}
