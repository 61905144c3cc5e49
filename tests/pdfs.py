"""Minimal PDFs, written by the tests."""

import zlib


def pdf(contents=(b"",), *, extra=(), root=b"", page=b"", info=b"", compress=False, media=b"[0 0 612 792]"):
    """A PDF with a page for each content stream. extra: further objects, numbered from 100."""
    objs = {1: b"<</Type/Catalog/Pages 2 0 R" + root + b">>", 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"}
    kids = []
    for k, c in enumerate(contents):
        n = 10 + 2 * k
        data = zlib.compress(c) if compress else c
        objs[n + 1] = b"<</Length %d%s>>stream\n%s\nendstream" % (len(data), b"/Filter/FlateDecode" if compress else b"", data)
        objs[n] = b"<</Type/Page/Parent 2 0 R/MediaBox " + media + b"/Resources<</Font<</F1 3 0 R>>/ExtGState<</G0 <</ca 0>>/G5 <</ca 0.5>>>>>>/Contents %d 0 R" % (n + 1) + page + b">>"
        kids.append(b"%d 0 R" % n)
    objs[2] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(kids))
    if info:
        objs[4] = info
    for k, o in enumerate(extra):
        objs[100 + k] = o
    return write(b"%PDF-1.4\n", objs, b"/Root 1 0 R" + (b"/Info 4 0 R" if info else b""))


def write(start, objs, trailer, prev=None):
    out, at = bytearray(start), {}
    for n, o in sorted(objs.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    table = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" if prev is None else b"xref\n"
    for n in sorted(at):
        out += b"%d 1\n%010d 00000 n \n" % (n, at[n])
    more = b"" if prev is None else b"/Prev %d" % prev
    return bytes(out + b"trailer\n<</Size %d%s%s>>\nstartxref\n%d\n%%%%EOF" % (max(at) + 200, trailer, more, table))


def save_again(raw, objs):
    """An incremental save on top of a PDF."""
    prev = int(raw.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    return write(raw + b"\n", objs, b"/Root 1 0 R", prev)


def text(x, y, s, size=12):
    return b"BT /F1 %d Tf %d %d Td (%s) Tj ET\n" % (size, x, y, s)


def box(x, y, w, h, gray=0):
    return b"q %s g %d %d %d %d re f Q\n" % (str(gray).encode(), x, y, w, h)
