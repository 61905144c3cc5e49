"""Formats of scanners, against writers of this module's own and Java's."""

import os
import struct
import zlib

import numpy as np
import pytest

from docsieve.functions import pixels
from docsieve.plans import api
from docsieve.sources import codecs
from docsieve.sources import images as im
from docsieve.sources.pdf import Document, PdfError

from .pdfs import pdf, text
from .test_files import errors, page, table

RNG = np.random.default_rng(11)
#: The example of the PDF reference.
PLAIN, CODED = bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66]), bytes.fromhex("800B6050220C0C8501")


def lzw_coded(data, early=1):
    codes, known, at = [(256, 9)], {bytes([k]): k for k in range(256)}, 0
    last, size, width = b"", 258, 9
    for k in range(len(data)):
        if last + data[k:k + 1] in known:
            last += data[k:k + 1]
            continue
        codes.append((known[last], width))
        known[last + data[k:k + 1]] = size
        size += 1
        width = max(9, (size - 1 + early).bit_length())
        if size == 4094:
            codes.append((256, width))
            known, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        last = data[k:k + 1]
    bits = "".join(f"{c:0{w}b}" for c, w in [*codes, (known[last], width), (257, max(9, (size + early).bit_length()))])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def packed(a, bits):
    """Rows of samples of a bit size as bytes."""
    if bits == 16:
        return [r.astype(">u2").tobytes() for r in a]
    rows = ["".join(f"{v:0{bits}b}" for v in r) for r in a]
    return [int(r + "0" * (-len(r) % 8), 2).to_bytes(-(-len(r) // 8), "big") for r in rows]


def png(a, bits, color, interlace=False, palette=b""):
    h, w, c = a.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    parts = [a[y::dy, x::dx] for x, y, dx, dy in im.PASSES] if interlace else [a]
    lines = b"".join(b"\0" + r for p in parts if p.size for r in packed(p.reshape(p.shape[0], -1), bits))
    return (im.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, color, 0, 0, int(interlace))) + (chunk(b"PLTE", palette) if palette else b"")
            + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def tiff(a, bits, meaning, code=lambda b: b, packing=1, planes=False, high=3, order="<", predictor=1, colors=()):
    h, w, c = a.shape
    strips = []
    for part in (np.split(a, c, axis=2) if planes else [a]):
        for y in range(0, h, high):
            p = part[y:y + high].astype(np.int64)
            if predictor == 2:
                p = np.diff(p, axis=1, prepend=0) % (1 << bits)
            rows = packed(p.reshape(p.shape[0], -1), bits)
            data = b"".join(rows)
            strips.append(code(data if bits != 16 or order == ">" else np.frombuffer(data, ">u2").astype("<u2").tobytes()))
    tags = {256: [w], 257: [h], 258: [bits] * c, 259: [packing], 262: [meaning], 277: [c], 278: [high], 284: [2 if planes else 1], 317: [predictor]}
    if len(colors):
        tags[320] = colors
    at = 8 + 2 + 12 * (len(tags) + 2) + 4
    tail, place = b"", []
    for s in strips:
        place.append(at + len(tail))
        tail += s
    tags |= {273: place, 279: [len(s) for s in strips]}
    out = struct.pack(order + "2sHIH", b"II" if order == "<" else b"MM", 42, 8, len(tags))
    for tag, v in sorted(tags.items()):
        kind = "I" if tag in (273, 279) else "H"
        body = struct.pack(f"{order}{len(v)}{kind}", *v)
        if len(body) > 4:
            body, tail = struct.pack(order + "I", at + len(tail)), tail + body
        out += struct.pack(order + "HHI", tag, 4 if kind == "I" else 3, len(v)) + body.ljust(4, b"\0")
    return out + bytes(4) + tail


def java_jpeg(spark, rgb):
    jvm = spark._jvm
    h, w = rgb.shape[:2]
    picture = jvm.java.awt.image.BufferedImage(w, h, 5)
    for y in range(h):
        for x in range(w):
            picture.setRGB(x, y, int.from_bytes(rgb[y, x].tobytes(), "big"))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    return bytes(out.toByteArray())


def test_lzw_and_run_lengths():
    assert codecs.lzw(CODED, 100) == PLAIN and lzw_coded(PLAIN) == CODED
    for n in (0, 1, 300, 5000, 90_000):
        data = bytes(RNG.integers(0, 7, n, dtype=np.uint8)) if n else b"\0"
        assert all(codecs.lzw(lzw_coded(data, early), 100_000, early) == data for early in (0, 1))
    with pytest.raises(ValueError, match="past the safe limit"):
        codecs.lzw(lzw_coded(bytes(5000)), 1000)
    with pytest.raises(ValueError, match="unknown"):
        codecs.lzw(b"\x80\x7f\xff\xff\xff", 1000)
    assert codecs.run_lengths(b"\x02abc\xfex\x80\x00y", 99, ends=True) == b"abcxxx"
    assert codecs.run_lengths(b"\x02abc\xfex\x80\x00y", 99, ends=False) == b"abcxxxy"


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("size", [(1, 1), (5, 3), (9, 17)])
def test_png_of_all_depths(size, interlace):
    for bits, color, channels in [(1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3), (8, 4, 2), (8, 6, 4), (16, 6, 4), (4, 3, 1)]:
        a = RNG.integers(0, 1 << bits, (*size, channels))
        palette = RNG.integers(0, 256, (16, 3), dtype=np.uint8)
        got, _ = im.decode(png(a, bits, color, interlace, palette.tobytes() if color == 3 else b""), alpha=True)
        eight = palette[a[:, :, 0]] if color == 3 else a >> 8 if bits == 16 else a * 255 // ((1 << bits) - 1)
        rgb = eight[:, :, :3] if eight.shape[2] >= 3 else np.repeat(eight[:, :, :1], 3, axis=2)
        assert (got[:, :, 2::-1] == rgb).all() and got.shape[2] == (4 if channels in (2, 4) else 3)
        if channels in (2, 4):
            assert (got[:, :, 3] == eight[:, :, -1]).all()


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_of_scanners(order):
    runs = lambda b: b"".join(b"\0" + b[k:k + 1] for k in range(len(b)))
    for planes in (False, True):
        for code, packing in ((bytes, 1), (zlib.compress, 8), (lzw_coded, 5), (runs, 32773)):
            for bits, predictor in ((8, 1), (8, 2), (16, 1), (16, 2)):
                a = RNG.integers(0, 1 << bits, (7, 5, 3))
                got, _ = im.decode(tiff(a, bits, 2, code, packing, planes, order=order, predictor=predictor))
                assert (got[:, :, ::-1] == (a >> (bits - 8))).all(), (planes, packing, bits, predictor)
    a = RNG.integers(0, 2, (7, 13, 1))
    for meaning in (0, 1):
        assert (im.decode(tiff(a, 1, meaning, order=order))[0][:, :, :1] == 255 * (a if meaning else 1 - a)).all()
    colors = RNG.integers(0, 65536, 48).tolist()
    b = RNG.integers(0, 16, (4, 6, 1))
    want = (np.array(colors).reshape(3, 16) >> 8).T[b[:, :, 0]]
    assert (im.decode(tiff(b, 4, 3, colors=colors, order=order))[0][:, :, ::-1] == want).all()
    with pytest.raises(im.ImageError):
        im.decode(tiff(a, 1, 1, packing=4))
    with pytest.raises(im.ImageError):
        im.decode(tiff(RNG.integers(0, 256, (7, 5, 3)), 8, 2)[:-60])


def test_alpha_stays_where_nothing_is_changed(spark):
    a = np.dstack([page()[:, :, ::-1], RNG.integers(0, 256, (400, 300), dtype=np.uint8)])
    barred = a.copy()
    barred[:, :20, :3] = 8
    out = {r["doc_id"]: r for r in api.process(table(spark, plain=png(a, 8, 6), barred=png(barred, 8, 6))).collect()}
    got, _ = im.decode(bytes(out["plain"]["output"]), alpha=True)
    assert out["plain"]["pages_flagged"] == 0 and (got[:, :, 3] == a[:, :, 3]).all() and (got[:, :, 2::-1] == a[:, :, :3]).all()
    got, _ = im.decode(bytes(out["barred"]["output"]), alpha=True)
    assert out["barred"]["pages_flagged"] == 1 and got.shape == (400, 300, 3) and (got == 240).all()


def test_jpeg_bytes(spark):
    plain, barred = java_jpeg(spark, page()), java_jpeg(spark, page([(0, 400, 0, 24)]))
    ridden = plain[:2] + b"\xff\xe1\x00\x08secret"[:10] + b"\xff\xfe\x00\x06note" + plain[2:] + b"after the end <script>"
    assert im.bare_jpeg(plain) == im.bare_jpeg(ridden) == im.bare_jpeg(im.bare_jpeg(plain))
    cut, broken = plain[:-2], plain[:200] + b"\xff\xd9"
    out = {r["doc_id"]: r for r in api.process(table(spark, plain=ridden, again=ridden, barred=barred, cut=cut, broken=broken), None, "crop").collect()}
    assert bytes(out["plain"]["output"]) == bytes(out["again"]["output"]) == im.bare_jpeg(plain) and out["plain"]["output_format"] == "jpeg"
    assert out["plain"]["pages_flagged"] == 0 and out["barred"]["pages_flagged"] == 1 and out["barred"]["output_format"] == "png"
    got, _ = im.decode(bytes(out["barred"]["output"]))
    assert got.shape[0] == 400 and 270 < got.shape[1] < 280 and (abs(got[:, 16:].astype(int) - 240) < 12).all()
    assert out["cut"]["error"].startswith("Malformed or corrupt image") and out["broken"]["error"].startswith("Malformed or corrupt image")
    assert errors(api.validate(table(spark, cut=cut, fine=plain)))["fine"] is None


def test_filters_of_pdfs():
    words = text(72, 700, b"kept")
    for name, data in (("LZWDecode", lzw_coded(words)), ("RunLengthDecode", b"".join(b"\0" + words[k:k + 1] for k in range(len(words))) + b"\x80")):
        stream = b"<</Filter/%s/Length %d>>stream\n%s\nendstream" % (name.encode(), len(data), data)
        doc, _ = Document.open(pdf([b""], extra=[stream]))
        assert doc.data(doc.object(100)) == words
    doc, _ = Document.open(pdf([b""], extra=[b"<</Filter/LZWDecode/Length 5>>stream\n\x80\x7f\xff\xff\xff\nendstream"]))
    with pytest.raises(PdfError):
        doc.data(doc.object(100))


@pytest.mark.parametrize(("head", "data", "found"), [
    (b"/BitsPerComponent 1/ColorSpace/DeviceGray", bytes(8), 1), (b"/BitsPerComponent 1/ColorSpace/DeviceGray", b"\xff" * 8, 0),
    (b"/BitsPerComponent 1/ColorSpace/DeviceGray", b"\xa5" * 8, 0), (b"/BitsPerComponent 16/ColorSpace/DeviceGray", b"\x10\xff" * 64, 1),
    (b"/BitsPerComponent 8/ColorSpace[/Indexed/DeviceRGB 1<000000FFFFFF>]", bytes(64), 1),
    (b"/BitsPerComponent 8/ColorSpace[/Indexed/DeviceRGB 1<000000FFFFFF>]", b"\1" * 64, 0),
    (b"/BitsPerComponent 4/ColorSpace[/Indexed/DeviceGray 2<FF1010>]", b"\x12" * 32, 1)])
def test_overlays_of_small_and_indexed_samples(spark, head, data, found):
    image = b"<</Type/XObject/Subtype/Image/Width 8/Height 8%s/Length %d>>stream\n%s\nendstream" % (head, len(data), data)
    raw = pdf([text(72, 700, b"under") + b"q 200 0 0 30 70 690 cm /X Do Q"], extra=[image]).replace(b"/Font<<", b"/XObject<</X 100 0 R>>/Font<<")
    assert api.audit_redactions(table(spark, a=raw))[0].where("source = 'image_overlay' and risk_level = 'critical'").count() == found


def test_row_filters_against_one_byte_at_a_time():
    from docsieve.sources.images import unfilter

    def plain(a, row, pixel):
        out, above = [], [0] * row
        for kind, *line in a.tolist():
            for x in range(row):
                left, corner = (line[x - pixel], above[x - pixel]) if x >= pixel else (0, 0)
                p = left + above[x] - corner
                near = sorted(((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner)))[0][2]
                line[x] = (line[x] + (0, left, above[x], (left + above[x]) // 2, near)[kind]) & 255
            out.append(line)
            above = line
        return out

    rng = np.random.default_rng(16)
    for kinds in ([0, 1, 2, 3, 4], [4], [3], [3, 4]):
        for _ in range(25):
            pixel, row, rows = (int(rng.integers(1, n)) for n in (5, 30, 40))
            a = rng.integers(0, 256, (rows, row + 1), dtype=np.uint8)
            a[:, 0] = rng.choice(kinds, rows)
            assert unfilter(a.tobytes(), row, pixel, rows, int(rng.integers(1, 20))).tolist() == plain(a, row, pixel)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name, most", [("image_clean", 2), ("pdf_clean", 1)])
def test_cleaned_files_are_made_once_for_all_that_reads_them(spark, name, most):
    from docsieve.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= most  # what reads the output back; the work itself is written


def test_edges_and_holes_are_looked_for_only_where_they_matter(monkeypatch):
    bar = np.full((40, 50, 3), 240, np.uint8)
    bar[:, :6] = 5
    want = pixels.dark_components(bar)
    monkeypatch.setattr(pixels, "_flood", None)
    assert pixels.dark_components(bar) == want and len(want) == 1  # it reaches the border, so it lies in no hole
    monkeypatch.setattr(pixels, "canny", None)
    assert pixels.dark_components(np.full((40, 50, 3), 240, np.uint8)) == []
