"""Colour spaces, tint functions, turned pages."""

import random

import pytest

from docsieve.plans import api
from docsieve.sources import pdf_color as c
from docsieve.sources import pdf_writer
from docsieve.sources.pdf import Document, Name, Painter, Stream, turned

from . import pdfs

DOC = Document(pdfs.pdf())
INK = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 0, 0, 0], "C1": [0, 0, 0, 1], "N": 1}


def close(a, b):
    return a is not None and len(a) == len(b) and all(abs(x - y) < 0.01 for x, y in zip(a, b))


@pytest.mark.parametrize("space, values, want", [
    (Name("DeviceGray"), [0.25], (0.25,) * 3), (Name("DeviceCMYK"), [0, 1, 0, 0.5], (0.5, 0, 0.5)), ([Name("CalRGB"), {}], [1, 0.5, 0], (1, 0.5, 0)),
    ([Name("Separation"), Name("Black"), Name("DeviceCMYK"), INK], [1], (0, 0, 0)), ([Name("Separation"), Name("Black"), Name("DeviceCMYK"), INK], [0], (1, 1, 1)),
    ([Name("Indexed"), Name("DeviceRGB"), 1, b"\xff\xff\xff\x00\x00\xff"], [1], (0, 0, 1)), ([Name("ICCBased"), Stream({"N": 4}, b"")], [0, 0, 0, 1], (0, 0, 0)),
    ([Name("Lab"), {"WhitePoint": [0.9642, 1, 0.8249]}], [100, 0, 0], (1, 1, 1)), ([Name("Lab"), {"WhitePoint": [0.9505, 1, 1.089]}], [0, 0, 0], (0, 0, 0)),
    ([Name("Lab"), {"WhitePoint": [0.9505, 1, 1.089]}], [53.24, 80.09, 67.2], (1, 0, 0)),
    ([Name("DeviceN"), [Name("A"), Name("B")], Name("DeviceRGB"), Stream({"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1] * 3}, b"{ 1 exch sub exch 1 exch sub dup }")], [1, 0.25], (0.75, 0, 0)),
])
def test_spaces(space, values, want):
    assert close(c.rgb(DOC, space, values), want)


@pytest.mark.parametrize("space, values", [
    (Name("Pattern"), []), (Name("DeviceRGB"), [1]), ([Name("Separation"), Name("None"), Name("DeviceCMYK"), INK], [1]), ([Name("Indexed"), Name("DeviceRGB"), 9, b"\0"], [3]),
    ([Name("Separation"), Name("X"), Name("DeviceRGB"), {"FunctionType": 9, "Domain": [0, 1]}], [1]), (None, [0]), ([], [0]), ([Name("ICCBased"), 3], [0])])
def test_what_cannot_be_evaluated_is_unknown(space, values):
    assert c.rgb(DOC, space, values) is None


def test_sampled_functions_are_linear_between_samples():
    table = Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 1], "Size": [2, 2], "BitsPerSample": 8}, bytes([0, 255, 255, 0]))
    for x, y, want in ((0, 0, 0), (1, 0, 1), (0, 1, 1), (1, 1, 0), (0.5, 0.5, 0.5), (0.5, 0, 0.5), (2, -1, 1)):
        assert close(c.call(DOC, table, [x, y]), (want,))
    narrow = Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [3], "BitsPerSample": 4, "Decode": [1, 0]}, bytes([0x0F, 0x00]))
    assert close(c.call(DOC, narrow, [0.5]), (0,)) and close(c.call(DOC, narrow, [0]), (1,)) and close(c.call(DOC, narrow, [0.75]), (0.5,))


def test_stitched_functions_meet_at_their_bounds():
    part = lambda a, b: {"FunctionType": 2, "Domain": [0, 1], "C0": [a], "C1": [b], "N": 1}
    f = {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.25, 0.5], "Encode": [0, 1, 1, 0, 0, 1], "Functions": [part(0, 1), part(0, 1), part(5, 6)], "Range": [0, 10]}
    for x, want in ((0, 0), (0.125, 0.5), (0.25, 1), (0.375, 0.5), (0.5, 5), (1, 6), (9, 6)):
        assert close(c.call(DOC, f, [x]), (want,))


@pytest.mark.parametrize("code, inputs, want", [
    ("{2 copy add}", [1, 2], [1, 2, 3]), ("{3 1 roll}", [1, 2, 3], [3, 1, 2]), ("{3 -1 roll}", [1, 2, 3], [2, 3, 1]), ("{1 index}", [4, 5], [4, 5, 4]),
    ("{dup 0.5 gt {pop 1} {pop 0} ifelse}", [0.7], [1]), ("{0.5 lt {9} if}", [0.7], []), ("{7 2 idiv 7 2 mod -7 2 idiv}", [], [3, 1, -3]),
    ("{360 sin 0 cos 1 0 atan}", [], [0, 1, 90]), ("{true not 5 cvr pop}", [], [0]), ("{3 truncate 2.5 round -2.5 round}", [], [3, 3, -2]), ("{2 3 exp 100 log}", [], [8, 2])])
def test_calculators(code, inputs, want):
    assert close(c.run(c.parse(code.encode()), inputs), want)


@pytest.mark.parametrize("code", ["{", "{}}", "{1 {2}}", "{unknown}", "{1 0 div}", "{pop}", "{-1 copy}"])
def test_broken_calculators_are_unknown(code):
    f = Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1]}, code.encode())
    assert c.rgb(DOC, [Name("Separation"), Name("X"), Name("DeviceGray"), f], [] if code == "{pop}" else [1]) is None


def test_a_spot_colour_box_over_text_is_critical_and_a_white_one_none(spark):
    spaces = [b"/ColorSpace<</S[/Separation/Black/DeviceCMYK<</FunctionType 2/Domain[0 1]/C0[0 0 0 0]/C1[0 0 0 1]/N 1>>]>>"]
    make = lambda fill: pdfs.pdf([pdfs.text(72, 700, b"hidden") + fill + b" 70 690 200 30 re f"]).replace(b"/Font<</F1", spaces[0] + b"/Font<</F1")
    fills = [b"/S cs 1 scn", b"/S cs 0 scn", b"/S cs", b"0 g", b"/Pattern cs /P scn"]
    _, reports, errors = api.audit_redactions(spark.createDataFrame(list(enumerate(map(make, fills))), "doc_id long, content binary"))
    assert not errors.count() and {r["doc_id"]: (r["total_boxes_found"], r["critical_count"]) for r in reports.collect()} == {
        0: (1, 1), 1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (0, 0)}


def test_turning_four_times_is_where_it_was():
    rng = random.Random(15)
    for _ in range(50):
        w, h = rng.randint(1, 900), rng.randint(1, 900)
        r = (1.0, 2.0, 30.0, 50.0)
        for turns in range(1, 4):
            size = (h, w) if turns % 2 else (w, h)
            assert turned(turned(r, turns, w, h), 4 - turns, *size) == r


@pytest.mark.parametrize("turns", [0, 1, 2, 3])
def test_turned_pages_keep_words_whole_and_are_edited_where_they_show(turns):
    content = pdfs.text(72, 700, b"two words") + pdfs.box(0, 0, 40, 792)
    doc = Document(pdfs.pdf([content], page=b"/Rotate %d" % (90 * turns)))
    painter = Painter(doc, doc.pages()[0])
    assert painter.size == ((792, 612) if turns % 2 else (612, 792)) and [w["word"] for w in painter.words] == ["two", "words"]
    bar = painter.drawings[0]["rect"]
    assert bar == ((0, 0, 40, 792), (0, 0, 792, 40), (572, 0, 612, 792), (0, 572, 792, 612))[turns]
    for change in (pdf_writer.masked, pdf_writer.redacted):
        out = Document(pdf_writer.rebuild(doc, {0: change(doc, doc.pages()[0], [bar], [1.0, 1.0, 1.0])}))
        again = Painter(out, out.pages()[0])
        assert again.drawings[-1]["rect"] == bar and again.drawings[-1]["fill"] == (1.0, 1.0, 1.0)
    word = painter.words[0]["rect"]
    out = Document(pdf_writer.rebuild(doc, {0: pdf_writer.redacted(doc, doc.pages()[0], [word], [0.0, 0.0, 0.0])}))
    assert not Painter(out, out.pages()[0]).words
