"""Writing PDFs: a rebuild of all objects that can be reached, and changes of page contents."""

from __future__ import annotations

import re
import zlib

from .pdf import Document, Name, Op, Painter, Ref, Stream, turned

#: Names that are written as they are.
_REGULAR = re.compile(r"[!\"$&-'*-.0-;=?-Z\\^-z|~]*\Z")


def _text(value) -> bytes:
    if value is None:
        return b"null"
    if value is True or value is False:
        return b"true" if value else b"false"
    if isinstance(value, (Name, Op)):
        if isinstance(value, Op):
            return value.encode("latin-1")
        if _REGULAR.match(value):
            return b"/" + value.encode()
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in value.encode("latin-1", "replace"))
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return (f"{value:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, list):
        return b"[" + b" ".join(map(_text, value)) + b"]"
    return b"<<" + b" ".join(_text(Name(k)) + b" " + _text(v) for k, v in value.items()) + b">>"


def rebuild(doc: Document, contents: dict[int, bytes] | None = None) -> bytes:
    """The document anew: reachable objects only, open and additional actions of catalog and pages gone.

    contents: new content streams by page number.
    """
    number: dict[int, int] = {}
    todo: list[int] = []
    page_of = {p["_ref"].num: k for k, p in enumerate(doc.pages()) if isinstance(p["_ref"], Ref)}

    def renumber(value):
        if isinstance(value, Ref):
            if value.num not in number:
                number[value.num] = len(number) + 1
                todo.append(value.num)
            return Ref(number[value.num], 0)
        if isinstance(value, list):
            return [renumber(v) for v in value]
        if isinstance(value, dict):
            return {k: renumber(v) for k, v in value.items()}
        return value

    head = {"Root": renumber(doc.trailer["Root"])}
    root = doc.trailer["Root"].num
    if isinstance(doc.trailer.get("Info"), Ref):
        head["Info"] = renumber(doc.trailer["Info"])
    done: dict[int, bytes] = {}
    extra: list[tuple[int, bytes]] = []
    while todo:
        num = todo.pop()
        value = doc.object(num)
        if isinstance(value, dict) and (num == root or num in page_of):
            value = {k: v for k, v in value.items() if k not in ("AA", "OpenAction")}
            if contents and (at := page_of.get(num)) in contents:
                fresh = -1 - at  # a number that no object of the file has
                number[fresh] = len(number) + 1
                packed = zlib.compress(contents[at])
                extra.append((number[fresh], _stream({"Length": len(packed), "Filter": Name("FlateDecode")}, packed)))
                value.pop("Contents", None)
                value = renumber(value) | {"Contents": Ref(number[fresh], 0)}
                done[number[num]] = _text(value)
                continue
        if isinstance(value, Stream):
            done[number[num]] = _stream({**renumber({k: v for k, v in value.head.items() if k != "Length"}), "Length": len(value.raw)}, value.raw)
        else:
            done[number[num]] = _text(renumber(value))
    done |= dict(extra)
    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    offsets = {}
    for num in sorted(done):
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num + done[num] + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(done) + 1)
    out += b"".join(b"%010d 00000 n \n" % offsets[k] for k in range(1, len(done) + 1))
    return bytes(out + b"trailer\n" + _text({"Size": len(done) + 1, **head}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


def _stream(head: dict, raw: bytes) -> bytes:
    return _text(head) + b"\nstream\n" + raw + b"\nendstream"


def masked(doc: Document, page: dict, rects: list[tuple], color: list[float]) -> bytes:
    """The page's content with filled rectangles on top."""
    return b"q\n" + doc.content(page) + b"\nQ\n" + _fills(doc, page, rects, color)


def _fills(doc: Document, page: dict, rects: list[tuple], color: list[float]) -> bytes:
    x, low, right, top = doc.box(page)
    if turns := doc.rotation(page):  # back to the page as it is written
        size = (right - x, top - low)[::-1] if turns % 2 else (right - x, top - low)
        rects = [turned(r, 4 - turns, *size) for r in rects]
    shapes = b"".join(b"%s re f\n" % b" ".join(_text(float(v)) for v in (x0 + x, top - y1, x1 - x0, y1 - y0)) for x0, y0, x1, y1 in rects)
    return b"q " + b" ".join(_text(float(c)) for c in color) + b" rg\n" + shapes + b"Q\n"


def redacted(doc: Document, page: dict, rects: list[tuple], color: list[float]) -> bytes:
    """The page's content without the text that overlaps the rectangles, and filled rectangles on top.

    A string that goes leaves a move of its width, so that the text after it stays where it is.
    """
    data, out, at = doc.content(page), bytearray(b"q\n"), 0
    for start, end, r, moved, size in Painter(doc, page).shows:
        if any(r[0] < x1 and r[2] > x0 and r[1] < y1 and r[3] > y0 for x0, y0, x1, y1 in rects):
            out += data[at:start] + (b"[%s] TJ" % _text(-moved / size * 1000 if size else 0.0))
            at = end
    return bytes(out + data[at:]) + b"\nQ\n" + _fills(doc, page, rects, color)
