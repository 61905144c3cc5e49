import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.functions import pixels
from docsieve.operators import actions, audit, jobs, revisions
from docsieve.plans import api
from docsieve.settings import Settings
from docsieve.sources import files as fs
from docsieve.sources import images as im
from docsieve.sources.pdf import Document, EncryptedError, PdfError

from .pdfs import box, pdf, save_again, text, write

FILES = "doc_id string, content binary"


def table(spark, **files):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], FILES)


def errors(df):
    return {r["doc_id"]: r["error"] for r in df.collect()}


# ---- reading and rebuilding -----------------------------------------------------------------------------------------------------


def test_read_words_drawings_and_opacity():
    raw = pdf([text(72, 700, b"Hello hidden world") + b"/G5 gs " + box(70, 690, 200, 30) + b"0 0 5 5 re S"], compress=True)
    out = fs.parse_one(raw)
    assert out["error"] is None and out["n_pages"] == 1
    assert [w["word"] for w in out["words"]] == ["Hello", "hidden", "world"]
    r = out["words"][0]["rect"]
    assert r["x0"] == 72 and 80 < r["y0"] < 92 < r["y1"] < 96  # y goes down from the top
    assert [(d["fill"], d["fill_opacity"]) for d in out["drawings"]] == [([0.0, 0.0, 0.0], 0.5), (None, None)]
    assert out["drawings"][0]["rect"] == {"x0": 70.0, "y0": 72.0, "x1": 270.0, "y1": 102.0}


def test_forms_matrices_and_kerning():
    form = b"<</Type/XObject/Subtype/Form/Matrix[1 0 0 1 100 0]/Length 26>>stream\n0 0 0 rg 0 0 10 10 re f   \nendstream"
    raw = pdf([b"q 2 0 0 2 0 0 cm /X Do Q BT /F1 10 Tf 1 0 0 1 50 50 Tm [(ab) -50 (c) -900 (d)] TJ ET"], extra=[form]).replace(b"/Font<<", b"/XObject<</X 100 0 R>>/Font<<")
    out = fs.parse_one(raw)  # offsets moved, so this is read by recovery
    assert out["recovered"] and out["drawings"][0]["rect"] == {"x0": 200.0, "y0": 772.0, "x1": 220.0, "y1": 792.0}
    assert [w["word"] for w in out["words"]] == ["abc", "d"]


def test_broken_files_are_errors_not_failures(spark):
    files = table(spark, empty=b"", junk=b"junk%PDF-", cut=pdf()[:60], js=pdf(root=b"/X<</S/JavaScript/JS(x)>>"), nul=None,
                  locked=pdf().replace(b"/Root 1 0 R", b"/Encrypt<<>>/Root 1 0 R"), nopages=write(b"%PDF-1.4\n", {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 0/Kids[]>>"}, b"/Root 1 0 R"),
                  fine=pdf([b""] * 3))
    e = errors(api.validate(files, Settings(max_pdf_pages=3)))
    assert e["fine"] is None and e["empty"] == e["nul"] == "Empty file." and e["junk"] == "Unrecognized or unsupported file type."
    assert e["js"] == r"Document rejected: contains disallowed active content (/JS\b, /JavaScript)."
    assert e["locked"] == fs.ERROR_ENCRYPTED and e["nopages"] == fs.ERROR_NO_PAGES and e["cut"]
    assert errors(api.validate(files.where("doc_id = 'fine'"), Settings(max_pdf_pages=2)))["fine"] == fs.ERROR_PAGES
    assert errors(api.validate(files.where("doc_id = 'fine'"), Settings(max_pdf_objects=3)))["fine"] == fs.ERROR_OBJECTS


def test_rebuild_keeps_content_and_drops_open_actions():
    raw = pdf([text(72, 700, b"kept")], root=b"/OpenAction 5 0 R/AA<</WC 5 0 R>>", info=b"<</CreationDate(D:2020)>>", extra=[b"(nobody refers to this)"])
    from docsieve.sources.pdf_writer import rebuild

    out = rebuild(Document.open(raw)[0])
    doc, recovered = Document.open(out)
    assert not recovered and b"OpenAction" not in out and b"/AA" not in out and b"nobody" not in out
    assert doc.info()[0] == "D:2020" and [w["word"] for w in fs.parse_one(out)["words"]] == ["kept"]


def test_xref_and_object_streams():
    import zlib

    body = b"1 0 2 33 3 75 <</Type/Catalog/Pages 2 0 R    >> <</Type/Pages/Count 1/Kids[3 0 R]    >> <</Type/Page/Parent 2 0 R/MediaBox[0 0 10 10]>>"
    first = body.index(b"<<")
    inner = body[first:]
    heads = [inner.index(b"<</Type/Catalog"), inner.index(b"<</Type/Pages"), inner.index(b"<</Type/Page/")]
    packed = zlib.compress(b"%d %d %d %d %d %d " % (1, heads[0], 2, heads[1], 3, heads[2]) + inner)
    n_first = len(b"%d %d %d %d %d %d " % (1, heads[0], 2, heads[1], 3, heads[2]))
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n<</Type/ObjStm/N 3/First %d/Length %d/Filter/FlateDecode>>stream\n%s\nendstream\nendobj\n" % (n_first, len(packed), packed)
    at5 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)]
    lines = [bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows]
    filtered = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(line, before)) for line, before in zip(lines, [bytes(4), *lines]))
    data = zlib.compress(filtered)
    out += b"5 0 obj\n<</Type/XRef/Size 6/W[1 2 1]/Root 1 0 R/Length %d/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>>>stream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(data), data, at5)
    doc, recovered = Document.open(out)
    assert not recovered and len(doc.pages()) == 1 and doc.n_objects() == 5
    assert len(Document(out, recover=True).pages()) == 1


def test_encryption_and_circles():
    with pytest.raises(EncryptedError):
        Document.open(pdf().replace(b"/Root 1 0 R", b"/Encrypt<<>>/Root 1 0 R"))
    with pytest.raises(PdfError):
        Document.open(b"%PDF-1.4 nothing here, and it goes on for a while without any object in it at all")
    loop = write(b"%PDF-1.4\n", {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[2 0 R]>>"}, b"/Root 1 0 R")
    assert Document.open(loop)[0].pages() == []


# ---- actions --------------------------------------------------------------------------------------------------------------------


def chain(n, last=b"Launch"):
    """n actions, each the next of the one before; objects 100.."""
    return [b"<</S/%s%s>>" % (b"GoTo" if k < n - 1 else last, b"/Next %d 0 R" % (101 + k) if k < n - 1 else b"") for k in range(n)]


@pytest.mark.parametrize(("links", "found"), [(26, True), (27, False)])
def test_chains_are_followed_to_depth_25(spark, links, found):
    # Lau#6eched: the raw scan for tokens reads literal bytes, the structure reads names
    raw = pdf(root=b"/AA<</O 100 0 R>>", extra=chain(links, b"Lau#6Ech"))
    e = errors(api.validate(table(spark, a=raw)))["a"]
    assert (e == "Document rejected: an additional-actions (/AA) trigger references disallowed action type(s) (Launch).") is found
    rows = spark.createDataFrame([(1, k, k - 1 if k else None, "GoTo" if k < links - 1 else "Launch") for k in range(links)], "doc_id int, action_id long, parent_id long, subtype string")
    assert (actions.dangerous_actions(rows).count() == 1) is found


def test_triggers_of_pages_annotations_and_fields(spark):
    js = b"<</S/Java#53cript>>"
    page = pdf(page=b"/AA<</O 100 0 R>>", extra=[js])
    annot = pdf(page=b"/Annots[<</AA<</E 100 0 R>>>>]", extra=[js])
    field = pdf(root=b"/AcroForm<</Fields[<</Kids[<</AA<</K 100 0 R>>>>]>>]>>", extra=[js])
    plain_a = pdf(page=b"/Annots[<</A 100 0 R>>]", extra=[js])  # actions of annotations themselves aren't walked
    e = errors(api.validate(table(spark, page=page, annot=annot, field=field, plain=plain_a)))
    assert all("(JavaScript)" in e[k] for k in ("page", "annot", "field")) and e["plain"] is None
    rel = fs.relations(fs.parse_pdfs(table(spark, page=page, annot=annot, field=field)))
    assert {(r["doc_id"], r["origin"]) for r in rel["actions"].collect()} == {("page", "page"), ("annot", "annot"), ("field", "field")}


# ---- audit ----------------------------------------------------------------------------------------------------------------------


def nested_forms(n):
    """A page whose text lies inside n forms."""
    inner = b"BT /F1 12 Tf 72 700 Td (hidden) Tj ET"
    forms = [b"<</Type/XObject/Subtype/Form/Resources<</XObject<</X %d 0 R>>/Font<</F1 3 0 R>>>>/Length %d>>stream\n%s\nendstream"
             % (101 + k, len(c), c) for k, c in enumerate([b"/X Do"] * (n - 1) + [inner])]
    return pdf([b"/X Do"], extra=forms, page=b"/Resources<</XObject<</X 100 0 R>>>>")


def deep_pages(n):
    objs = {1: b"<</Type/Catalog/Pages 100 0 R>>", 3: b"<</Type/Page/MediaBox[0 0 612 792]>>"}
    objs |= {100 + k: b"<</Type/Pages/Count 1/Kids[%d 0 R]>>" % (101 + k if k < n - 1 else 3) for k in range(n)}
    return write(b"%PDF-1.4\n", objs, b"/Root 1 0 R")


def many_actions(n):
    return pdf([text(72, 700, b"x")], root=b"/AA<</WC<</S/GoTo/Next[%s<</S/Laun#63h>>]>>>>" % (b"<</S/GoTo>>" * n))


def test_a_document_past_a_limit_is_refused_not_judged_on_a_part(spark):
    assert [w["word"] for w in fs.parse_one(nested_forms(12))["words"]] == ["hidden"]
    assert len(fs.parse_one(deep_pages(60))["pages"]) == 1
    assert [a["subtype"] for a in fs.parse_one(many_actions(3))["actions"]][-1] == "Launch"
    past = {"forms": nested_forms(13), "page tree": deep_pages(62), "actions": many_actions(100_001)}
    for what, raw in past.items():
        got = fs.parse_one(raw)
        assert what in (got["error"] or "") and not got["words"] and not got["actions"], what
    judged = errors(api.validate(table(spark, **past)))
    assert judged["page tree"] and judged["actions"]  # what is drawn is read by the audit
    assert {r["doc_id"] for r in api.audit_redactions(table(spark, **past))[2].collect()} == set(past)


def test_audit_end_to_end(spark):
    secret = text(72, 700, b"top secret")
    docs = table(spark, over=pdf([secret + box(70, 690, 200, 30)]), clear=pdf([secret + box(70, 300, 200, 30)]), none=pdf([secret]),
                 zero=pdf([secret + b"/G0 gs " + box(70, 690, 200, 30)]), twice=pdf([secret + box(70, 690, 200, 30)], page=b"/Annots[<</Subtype/Redact/Rect[70 690 270 720]>>]"),
                 annot=pdf([b""], page=b"/Annots[<</Subtype/Redact/Rect[70 690 270 720]>>]"), bad=b"nope")
    found, reports, errs = api.audit_redactions(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["source_order"], r["risk_level"], r["underlying_word_count"], r["underlying_char_count"]))
    assert got["over"] == got["zero"] == [(2, "critical", 2, 10)] and got["clear"] == [(2, "clear", 0, 0)]
    assert sorted(got["twice"]) == [(1, "critical", 2, 10), (2, "critical", 2, 10)]  # sources aren't merged
    assert got["annot"] == [(1, "critical", 0, 0)] and "none" not in got
    rep = {r["doc_id"]: r for r in reports.collect()}
    assert rep["none"]["summary"] == audit.SUMMARY_NONE and rep["clear"]["summary"] == audit.SUMMARY_CLEAR % 1
    assert rep["twice"]["summary"] == audit.SUMMARY_CRITICAL % 2 and rep["over"]["pages_audited"] == 1 and rep["over"]["unknown_count"] == 0
    assert [r["doc_id"] for r in errs.collect()] == ["bad"]
    assert "revealed_text" not in found.columns and "text" not in found.columns
    with pytest.raises(ValueError):
        api.reveal_text(docs, "over")
    assert [r["revealed_text"] for r in api.reveal_text(docs, "over", confirm_ownership=True).collect()] == ["top secret"]


def test_flat_image_over_text(spark):
    image = lambda n: b"<</Type/XObject/Subtype/Image/Width 4/Height 4/BitsPerComponent 8/ColorSpace/DeviceGray/Length 16>>stream\n" + bytes(range(0, 16 * n, n)) if n else b""
    flat = b"<</Type/XObject/Subtype/Image/Width 4/Height 4/BitsPerComponent 8/ColorSpace/DeviceGray/Length 16>>stream\n" + bytes([20] * 16) + b"\nendstream"
    noisy = image(9) + b"\nendstream"
    for body, n in ((flat, 1), (noisy, 0)):
        raw = pdf([text(72, 700, b"under") + b"q 200 0 0 30 70 690 cm /X Do Q"], extra=[body]).replace(b"/Font<<", b"/XObject<</X 100 0 R>>/Font<<")
        found, _, _ = api.audit_redactions(table(spark, a=raw))
        assert [(r["source"], r["risk_level"]) for r in found.collect()] == [("image_overlay", "critical")] * n


# ---- revisions ------------------------------------------------------------------------------------------------------------------


def test_revisions_and_extraction(spark):
    first = pdf([text(72, 700, b"draft")], info=b"<</CreationDate(D:1)/ModDate(D:2)>>")
    two = save_again(first, {11: b"<</Length 32>>stream\nBT /F1 12 Tf 72 700 Td (final) Tj ET\nendstream".replace(b"32", b"33")})
    docs = table(spark, one=first, two=two, crlf=first + b"\r\n", image=im.encode(np.zeros((2, 2, 3), np.uint8), "PNG"))
    revs, reports, errs = api.discover_revisions(docs)
    got = {(r["doc_id"], r["revision_index"]): r for r in revs.collect()}
    assert sorted(got) == [("crlf", 1), ("one", 1), ("two", 1), ("two", 2)]
    assert got["one", 1]["is_current"] and got["one", 1]["creation_date"] == "D:1" and got["one", 1]["page_count"] == 1
    assert not got["two", 1]["is_current"] and got["two", 1]["openable"] and got["two", 2]["is_current"]
    assert not got["crlf", 1]["is_current"]  # two bytes after the end make the only save a prior one
    rep = {r["doc_id"]: r for r in reports.collect()}
    assert rep["one"]["summary"] == revisions.SUMMARY_NONE and rep["two"]["summary"] == revisions.SUMMARY_PRIOR % 1
    assert rep["two"]["pages_in_current_revision"] == 1 and rep["crlf"]["pages_in_current_revision"] is None and not rep["two"]["truncated"]
    assert errors(errs) == {"image": api.ERROR_PDF_ONLY}
    with pytest.raises(ValueError, match="confirm_ownership"):
        api.extract_revision(docs, "two", 1)
    with pytest.raises(ValueError, match="out of range"):
        api.extract_revision(docs, "two", 3, confirm_ownership=True)
    words = lambda raw: [w["word"] for w in fs.parse_one(raw)["words"]]
    assert words(api.extract_revision(docs, "two", 1, confirm_ownership=True)) == ["draft"] and words(two) == ["final"]


def test_caps_of_boundaries_and_reports(spark):
    many = b"%PDF-1.4 " + b"startxref 1 %%EOF\n" * 201
    bounds = revisions.boundaries(table(spark, a=many, b=b"%PDF-1.4 " + b"startxref 1 %%EOF\n" * 50))
    assert {r["doc_id"]: len(r["offsets"]) for r in bounds.collect()} == {"a": 200, "b": 50}
    # no boundary at all in a long file: it is read once
    assert revisions.boundaries(table(spark, a=b"%PDF-1.4 " + b"x1 " * 700_000)).first()["offsets"] == []
    revs = revisions.revisions(bounds)
    assert revs.groupBy("doc_id").count().where("count = 50").count() == 2
    rep = revisions.report(revs.withColumns({"openable": F.lit(False), "page_count": F.lit(None).cast("int")}), bounds)
    assert {r["truncated"] for r in rep.collect()} == {True}
    assert api.inspect_slice(b"short")["note"] == api.NOTE_SMALL and api.inspect_slice(b"x" * 80)["note"] == api.NOTE_UNPARSED


# ---- cleaning -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mode", ["mask", "redact", "other"])
def test_clean_pdfs(spark, mode):
    raw = pdf([text(5, 400, b"side") + text(200, 400, b"body") + box(0, 0, 40, 792), text(72, 700, b"plain")])
    out = {r["doc_id"]: r for r in api.process(table(spark, a=raw, bad=b"zzz"), mode).collect()}
    assert out["a"]["pages_flagged"] == 1 and out["a"]["output_format"] == "pdf" and out["bad"]["error"]
    seen = fs.parse_one(bytes(out["a"]["output"]))
    words = [w["word"] for w in seen["words"]]
    assert words == (["body", "plain"] if mode == "redact" else ["side", "body", "plain"])
    assert seen["drawings"][-1]["fill"] == [1.0, 1.0, 1.0] and seen["drawings"][-1]["rect"] == seen["drawings"][0]["rect"]


def page(bars=(), shade=None):
    a = np.full((400, 300, 3), 240, np.uint8)
    for y0, y1, x0, x1 in bars:
        a[y0:y1, x0:x1] = 8
    if shade is not None:
        a[:, :shade] = np.linspace(0, 240, shade).astype(np.uint8)[None, :, None]
    return a


def test_clean_images(spark):
    bars = {"left": [(0, 400, 0, 20)], "topfull": [(0, 20, 0, 300)], "topinset": [(0, 20, 15, 285)], "frame": [(0, 400, 0, 15), (0, 400, 285, 300), (0, 15, 0, 300), (385, 400, 0, 300)]}
    files = {k: im.encode(page(v), "PNG") for k, v in bars.items()} | {"vignette": im.encode(page(shade=150), "TIFF")}
    for mode in ("paint", "crop"):
        out = {r["doc_id"]: r for r in api.process(table(spark, **files), None, mode).collect()}
        assert {k: r["pages_flagged"] for k, r in out.items()} == {"left": 1, "topfull": 0, "topinset": 1, "frame": 0, "vignette": 0}
        bgr, _ = im.decode(bytes(out["left"]["output"]))
        assert (bgr == 240).all() and bgr.shape == ((400, 300, 3) if mode == "paint" else (400, 280, 3))


def test_image_guards_and_headers(spark):
    small = Settings(max_image_dimension=100, max_image_pixels=2000)
    png = lambda h, w: im.encode(np.zeros((h, w, 3), np.uint8), "PNG")
    e = errors(api.validate(table(spark, side=png(1, 101), area=png(50, 41), fine=png(50, 40), broken=png(9, 9)[:40] + b"xx"), small))
    assert e["fine"] is None and "101" not in e["side"] and "per-side" in e["side"] and "pixel count" in e["area"] and e["broken"].startswith("Malformed")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x07\x00\x09\x03"
    assert im.dimensions(jpeg + bytes(20)) == ("JPEG", 9, 7)
    assert im.dimensions(im.encode(np.zeros((3, 5, 3), np.uint8), "TIFF")) == ("TIFF", 5, 3)


def test_files_and_pixels_from_a_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(im.encode(page([(0, 400, 0, 20)]), "PNG"))
    (tmp_path / "b.png").write_bytes(b"zz")
    assert fs.read_files(spark, str(tmp_path)).count() == 2
    assert fs.read_files(spark, str(tmp_path), Settings(max_upload_bytes=10), oversized=False).count() == 1
    images = fs.read_pixels(spark, str(tmp_path)).withColumn("format", F.lit("PNG"))
    out, bands = api.clean_images(images)
    assert [(r["side"], r["w"]) for r in bands.collect()] == [("left", 20)] and out.first()["pages_flagged"] == 1


def test_components_against_flood_fill():
    rng = np.random.default_rng(4)
    for _ in range(60):
        m = rng.random(tuple(rng.integers(1, 13, 2))) < rng.random()
        seen, n = np.zeros(m.shape, int), 0
        for y, x in zip(*np.nonzero(m)):
            if not seen[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < m.shape[0] and 0 <= j < m.shape[1] and m[i, j] and not seen[i, j]:
                        seen[i, j] = n
                        todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        got = pixels.components(m)
        pairs = set(zip(got.ravel().tolist(), seen.ravel().tolist()))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_closing_against_definition():
    rng = np.random.default_rng(6)
    m = rng.random((20, 17)) < 0.1
    h, w = m.shape
    win = lambda a, y, x: a[max(0, y - 4):y + 5, max(0, x - 4):x + 5]
    grown = np.array([[win(m, y, x).any() for x in range(w)] for y in range(h)])
    assert (pixels.close_mask(m) == np.array([[win(grown, y, x).all() for x in range(w)] for y in range(h)])).all()


# ---- jobs -----------------------------------------------------------------------------------------------------------------------


def test_job_states(spark):
    rows = [("PENDING", None), ("STARTED", None), ("RETRY", None), ("FAILURE", None), ("SUCCESS", False), ("SUCCESS", True), ("LOST", None)]
    df = spark.createDataFrame(rows, "s string, f boolean").select(jobs.status_of(F.col("s"), F.col("f")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["queued", "processing", "queued", "failed", "complete", "failed", "queued"]
    kinds = spark.createDataFrame([("pdf",), ("tiff",), ("bmp",)], "f string").select(jobs.media_type(F.col("f")).alias("m"))
    assert [r["m"] for r in kinds.collect()] == ["application/pdf", "image/tiff", "application/octet-stream"]


def test_stream_of_files(spark, tmp_path):
    from docsieve.streaming import jobs as stream

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(pdf([text(72, 700, b"x")]))
    (inbox / "b.pdf").write_bytes(b"nope")

    def operation(df):
        return api.validate(df).select("doc_id", "kind", "page_count", "error")

    for _ in range(2):
        stream.run_jobs(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp"), operation).awaitTermination(120)
    done = stream.results(spark, str(tmp_path / "out"))
    assert sorted((r["doc_id"][-5:], r["status"]) for r in done.collect()) == [("a.pdf", "complete"), ("b.pdf", "failed")]
    assert stream.results(spark, str(tmp_path / "out"), done.where("error is null").select("doc_id")).count() == 1
    assert stream.results(spark, str(tmp_path / "out"), settings=Settings(job_ttl_seconds=0)).count() == 0
    assert len(list(inbox.iterdir())) == 2  # inputs stay


def test_two_million_triggers_and_a_cycle(spark):
    rows = spark.range(2_000_000).selectExpr("id % 7 as doc_id", "id as action_id", "cast(null as long) as parent_id", "if(id = 3, 'Launch', 'GoTo') as subtype")
    more = spark.createDataFrame([(1, 9_000_000, 1, None), (1, 9_000_001, 9_000_000, "JavaScript"), (1, 9_000_000, 9_000_001, None), (2, 9_000_002, 9_000_002, "Launch")], "doc_id long, action_id long, parent_id long, subtype string")
    got = {r["doc_id"]: r["subtypes"] for r in actions.dangerous_actions(rows.unionByName(more)).collect()}
    assert got == {3: ["Launch"], 1: ["JavaScript"]}


def test_streams_that_inflate_past_the_limit_are_errors(monkeypatch):
    import zlib

    from docsieve.sources import images, pdf

    monkeypatch.setattr(pdf, "MAX_STREAM", 1000)
    assert pdf._inflate(zlib.compress(b"x" * 1000)) == b"x" * 1000
    with pytest.raises(pdf.PdfError, match="past the safe limit"):
        pdf._inflate(zlib.compress(b"x" * 100_000))
    assert len(images._inflate(zlib.compress(b"x" * 100_000), 10)) == 10


def test_intermediate_tables_of_a_batch_are_deleted_and_nothing_stays_cached(spark, tmp_path):
    from docsieve import storage

    with storage.scratch(spark):
        kept = storage.materialize(spark.range(5))
        home = storage.shared_dir(spark).rsplit("/", 1)[0]
        assert kept.count() == 5 and storage.exists(spark, home)
    assert not storage.exists(spark, home) and storage.shared_dir(spark).rsplit("/", 1)[0] != home
    files = spark.createDataFrame([("a", b"%PDF-1.4 nothing"), ("b", b"")], "doc_id string, content binary")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert api.process(files).count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_extractions_are_recorded_whatever_comes_of_them(spark, tmp_path):
    raw = save_again(pdf([text(72, 700, b"old")]), {11: b"<</Length 0>>stream\n\nendstream"})
    files = spark.createDataFrame([("a", raw), ("b", raw.replace(b"/Pages 2 0 R", b"/Pages 2 0 R/AA<</O<</S/Laun#63h>>>>", 1))], "doc_id string, content binary")
    table = str(tmp_path / "log")
    out = api.extract_revision(files, "a", 1, True, audit_table=table)
    for args in (("a", 9, True), ("b", 1, True)):
        with pytest.raises(ValueError):
            api.extract_revision(files, *args, audit_table=table)
    with pytest.raises(ValueError, match="confirm_ownership"):
        api.extract_revision(files, "a", 1, audit_table=table)
    got = {(r["doc_id"], r["revision_index"]): (r["outcome"], r["bytes"]) for r in api.extractions(spark, table).collect()}
    assert got == {("a", 1): ("completed", len(out)), ("a", 9): ("refused", None), ("b", 1): ("refused", None)}


def test_first_error_of_facts(spark):
    from docsieve.sources import files as source

    rows = [("read", "broken", 9, 9, ["Launch"]), ("objects", None, 9, 9, ["Launch"]), ("pages", None, 1, 9, ["Launch"]), ("actions", None, 1, 0, ["Launch", "GoTo", "Launch"]),
            ("none", None, 1, 0, []), ("fine", None, 1, 1, ["GoTo"]), ("image", None, None, 1, [])]
    df = spark.createDataFrame(rows, "doc_id string, error string, n_objects int, n_pages int, subtypes array<string>")
    got = {r["doc_id"]: r["e"] for r in df.select("doc_id", api.screened(Settings(max_pdf_objects=5, max_pdf_pages=5)).alias("e")).collect()}
    assert got == {"read": "broken", "objects": source.ERROR_OBJECTS, "pages": source.ERROR_PAGES, "none": source.ERROR_NO_PAGES, "fine": None, "image": None,
                   "actions": "Document rejected: an additional-actions (/AA) trigger references disallowed action type(s) (Launch)."}
