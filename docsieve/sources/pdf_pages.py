"""PDF pages as a Spark data source: spark.read.format("pdf_pages").load(folder).

One row a page: path, length, page_number, page_rect, error, and the relations drawings, words, page_images and annots as arrays. A file
is many partitions, each a range of its pages, so a long document is many tasks. Filters on path and length are applied to the listing,
before any file is read; filters on page_number before a page's content is. Options: pages (pages a partition at most, 25), relations
(names, comma separated; the others stay empty and cost nothing but their parsing), and max_upload_bytes, max_pdf_pages and
max_pdf_objects as in Settings.

Defined results: a file that can't be read, or is past a limit, is one row with an error and no page; a page that can't be read is a row
with an error; files of no bytes are rows with an error; an empty folder has no rows.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..settings import DEFAULT, Settings

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
RELATIONS = ("drawings", "words", "page_images", "annots")
SCHEMA = (f"path string, length bigint, page_number int, page_rect {RECT}, error string, "
          f"drawings array<struct<page_number:int,seq:int,rect:{RECT},fill:array<double>,fill_opacity:double,"
          "even_odd:boolean,path:array<double>,clips:array<struct<even_odd:boolean,path:array<double>>>>>, "
          f"words array<struct<page_number:int,word_seq:int,rect:{RECT},word:string>>, "
          f"page_images array<struct<page_number:int,seq:int,rect:{RECT},n_channels:int,variance:double,mean_intensity:double>>, "
          f"annots array<struct<page_number:int,seq:int,subtype:string,rect:{RECT}>>")
#: A page takes this many bytes of a file at least, so far as the number of ranges is concerned.
PAGE_BYTES = 2_000


class _Pages(InputPartition):
    """Range k of n of the pages of a file."""

    def __init__(self, path: str, length: int, k: int, n: int):
        self.path, self.length, self.k, self.n = path, length, k, n


_HOLDS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
          LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def _holds(f: Filter, value) -> bool:
    return value is not None and _HOLDS[type(f)](value, f.value)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("pdf_pages needs a path")
        self.pages = max(1, int(options.get("pages", 25)))
        self.relations = {x.strip() for x in options.get("relations", ",".join(RELATIONS)).split(",") if x.strip()}
        if unknown := self.relations - set(RELATIONS):
            raise ValueError(f"pdf_pages has no relation {sorted(unknown)}")
        own = {k: int(options[k]) for k in ("max_upload_bytes", "max_pdf_pages", "max_pdf_objects") if k in options}
        self.settings: Settings = replace(DEFAULT, **own)
        self.filters: dict[str, list[Filter]] = {"path": [], "length": [], "page_number": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if type(f) in _HOLDS and f.attribute[0] in self.filters and len(f.attribute) == 1:
                self.filters[f.attribute[0]].append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, length in _list(self.path):
            if all(_holds(f, path) for f in self.filters["path"]) and all(_holds(f, length) for f in self.filters["length"]):
                # by size, since the number of pages isn't known before a file is read; ranges past its pages are empty
                n = min(-(-self.settings.max_pdf_pages // self.pages), max(1, -(-length // (PAGE_BYTES * self.pages))))
                n = 1 if length > self.settings.max_upload_bytes else n
                out += [_Pages(path, length, k, n) for k in range(n)]
        return out or [_Pages("", -1, 0, 1)]

    def read(self, part: _Pages) -> Iterator[tuple]:
        from . import files as fs

        if part.length < 0:
            return
        wanted = self.filters["page_number"]
        blank = (None, *([] for _ in RELATIONS))
        raw, error = b"", None
        if part.length > self.settings.max_upload_bytes:
            error = f"File exceeds maximum allowed size of {self.settings.max_upload_bytes} bytes."
        else:
            raw = _bytes_of(part.path)
        doc = None
        if error is None:
            doc, _, error = fs.open_pdf(raw, self.settings)
        if doc is None:
            if part.k == 0 and not wanted:
                yield part.path, part.length, None, None, error, *blank[1:]
            return
        pages = doc.pages()
        lo, hi = len(pages) * part.k // part.n, len(pages) * (part.k + 1) // part.n
        for number in range(lo, hi):
            if not all(_holds(f, number) for f in wanted):
                continue
            try:
                rows = fs.page_rows(doc, number, pages[number])
            except fs.PdfError as e:
                yield part.path, part.length, number, None, f"Malformed or corrupt PDF: {e}", *blank[1:]
                continue
            except Exception:  # noqa: BLE001 - one bad page must not end a job
                yield part.path, part.length, number, None, fs.ERROR_INTERNAL, *blank[1:]
                continue
            yield part.path, part.length, number, rows["pages"][0]["page_rect"], None, *(rows[name] if name in self.relations else [] for name in RELATIONS)


def _list(path: str) -> list[tuple[str, int]]:
    """(path, length) of a file, or of all files below a folder, in order."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, at = FileSystem.from_uri(path) if "://" in path or path.startswith("/") else FileSystem.from_uri(posixpath.abspath(path))
    info = fs.get_file_info(at)
    found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(at, recursive=True)) if info.type == FileType.Directory else None
    if found is None:
        raise FileNotFoundError(path)
    head = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((head + f.path, f.size) for f in found if f.type == FileType.File and not f.base_name.startswith((".", "_")))


def _bytes_of(path: str) -> bytes:
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return f.read()


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfPages)
