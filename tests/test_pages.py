"""Pages as a data source, and the time limit of a document."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.settings import Settings
from docsieve.sources import files as fs
from docsieve.sources import pdf_pages

from . import pdfs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    home = tmp_path_factory.mktemp("pages")
    (home / "deep").mkdir()
    (home / "a.pdf").write_bytes(pdfs.pdf([pdfs.text(72, 700, b"one") + pdfs.box(9, 9, 50, 50), b"", pdfs.text(72, 600, b"three here")]))
    (home / "deep" / "long.pdf").write_bytes(pdfs.pdf([pdfs.text(72, 700, b"page %d" % k) for k in range(120)], page=b"/Annots[<</Subtype/Redact/Rect[1 2 3 4]>>]"))
    (home / "no.pdf").write_bytes(b"no document")
    (home / "_hidden.pdf").write_bytes(b"")
    return str(home)


def test_pages_equal_parsing_whole_files(spark, folder):
    pdf_pages.register(spark)
    got = spark.read.format("pdf_pages").option("pages", 7).load(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("length > 0").select(
        F.regexp_replace("path", "^file:", "").alias("doc_id"), "content")
    parsed = fs.parse_pdfs(files)
    want = fs.relations(parsed.where("error is null"))
    for name in pdf_pages.RELATIONS:
        rows = got.select(F.col("path").alias("doc_id"), F.explode(name).alias("r")).select("doc_id", "r.*")
        assert sorted(map(str, rows.collect())) == sorted(map(str, want[name].select(*rows.columns).collect())), name
    assert sorted(map(str, got.where("error is null").select(F.col("path").alias("doc_id"), "page_number", "page_rect").collect())) == sorted(map(str, want["pages"].collect()))
    bad = got.where("error is not null").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["page_number"]) for r in bad] == [("no.pdf", None)]
    assert got.rdd.getNumPartitions() >= 5  # the long file is many tasks


def test_filters_reach_the_source(spark, folder, capfd):
    pdf_pages.register(spark)
    pages = spark.read.format("pdf_pages").option("pages", 10).option("relations", "words").load(folder)
    few = pages.where("page_number = 2 and length > 100 and error is null")
    few.explain("formatted")
    plan = capfd.readouterr().out
    assert "page_number" in plan.split("PushedFilters", 1)[1] and "length" in plan.split("PushedFilters", 1)[1]
    rows = few.collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows) == ["a.pdf", "long.pdf"] and all(not r["annots"] and r["words"] for r in rows)
    assert pages.where(F.col("path").endswith("a.pdf")).count() == 3 and pages.where("length < 0").count() == 0
    assert pages.where("page_number in (118, 119, 500)").count() == 2 and pages.where("page_number is null").count() == 1


def test_limits_and_options_of_the_source(spark, folder, tmp_path):
    pdf_pages.register(spark)
    small = spark.read.format("pdf_pages").option("max_upload_bytes", 3000).option("max_pdf_pages", 2).load(folder).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["error"] for r in small} == {
        "a.pdf": fs.ERROR_PAGES, "long.pdf": "File exceeds maximum allowed size of 3000 bytes.", "no.pdf": next(r["error"] for r in small if r["path"].endswith("no.pdf"))}
    assert spark.read.format("pdf_pages").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no relation"):
        spark.read.format("pdf_pages").option("relations", "x").load(folder).collect()
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("pdf_pages").load().collect()


def test_a_document_that_never_ends_is_an_error_row_and_the_others_go_on(spark):
    def make(doc_id, content):
        try:
            while content == b"loop":
                pass
        except Exception:  # noqa: BLE001 - what a parser does with faults of a document
            pass
        yield doc_id, [1], None

    run = fs.by_row(make, {"doc_id": None, "rows": pa.list_(pa.int64()), "error": pa.string()}, limit=0.3)
    df = spark.createDataFrame([(1, b"a"), (2, b"loop"), (3, b"b"), (4, b"loop")], "doc_id long, content binary").coalesce(1)
    began = time.monotonic()
    got = {r["doc_id"]: (r["rows"], r["error"]) for r in df.mapInArrow(run, "doc_id long, rows array<long>, error string").collect()}
    assert got == {1: ([1], None), 2: ([], fs.ERROR_LIMIT), 3: ([1], None), 4: ([], fs.ERROR_LIMIT)} and time.monotonic() - began < 30


def test_parsing_has_the_limit_of_the_settings(spark, monkeypatch):
    raw = pdfs.pdf([b"0 0 1 1 re f\n" * 200_000])
    df = spark.createDataFrame([("slow", raw), ("fine", pdfs.pdf())], "doc_id string, content binary")
    got = {r["doc_id"]: r["error"] for r in fs.parse_pdfs(df, Settings(processing_timeout_seconds=0.2)).select("doc_id", "error").collect()}
    assert got == {"slow": fs.ERROR_LIMIT, "fine": None}


def test_plain_objects_are_read_by_one_pattern(monkeypatch):
    from docsieve.sources import pdf as p

    data = b" % note 1 0 R\n/A#42c 12 0 R\r3.5 -7 +.5/ 1 0 RG"
    assert [p.Lexer(b"true null", k).value() for k in (0, 4)] == [True, None] and isinstance(p.Lexer(b"1e").value(), p.Op)
    monkeypatch.setattr(p, "_TOKEN", None)  # for other words alone
    lex = p.Lexer(data)
    assert [lex.value() for _ in range(8)] == [p.Name("ABc"), p.Ref(12, 0), 3.5, -7, 0.5, p.Name(""), 1, 0]
