"""Headers, decoding and encoding of PNG and TIFF bytes; of JPEG bytes what surrounds the pixels, which Spark's image source decodes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .codecs import lzw, run_lengths, samples, to_bytes

PNG = b"\x89PNG\r\n\x1a\n"


class ImageError(ValueError):
    """Why an image can't be read."""


def dimensions(raw: bytes) -> tuple[str, int, int]:
    """(format, width, height) from the header, without decoding."""
    try:
        if raw.startswith(PNG):
            w, h = struct.unpack(">II", raw[16:24])
            return "PNG", w, h
        if raw.startswith(b"\xff\xd8\xff"):
            at = 2
            while at + 9 < len(raw):
                if raw[at] != 0xFF:
                    at += 1
                    continue
                kind = raw[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", raw[at + 5:at + 9])
                    return "JPEG", w, h
                at += 2 if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD9 else 2 + struct.unpack(">H", raw[at + 2:at + 4])[0]
            raise ImageError("no frame header")
        if raw[:4] in (b"II*\0", b"MM\0*"):
            tags = _tags(raw)
            return "TIFF", tags[256][0], tags[257][0]
    except (struct.error, KeyError, IndexError) as e:
        raise ImageError(f"broken header: {e}") from None
    raise ImageError("unknown format")


def _tags(raw: bytes) -> dict[int, list[int]]:
    """Integer tags of the first frame of a TIFF file."""
    o = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack(o + "I", raw[4:8])
    (n,) = struct.unpack(o + "H", raw[at:at + 2])
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack(o + "HHI", raw[at + 2 + 12 * k:at + 10 + 12 * k])
        form = {1: "B", 3: "H", 4: "I"}.get(kind)
        if not form:
            continue
        size = struct.calcsize(form) * count
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack(o + "I", raw[place:place + 4])
        out[tag] = list(struct.unpack(f"{o}{count}{form}", raw[place:place + size]))
    return out


def decode(raw: bytes, alpha: bool = False) -> tuple[np.ndarray, str]:
    """(pixels as height, width, 3 in blue-green-red, format) of PNG and TIFF bytes; with `alpha`, a fourth channel where a PNG has one.

    Samples of 16 bits are cut to their upper 8.
    """
    fmt, w, h = dimensions(raw)
    try:
        rgb = _png(raw, w, h) if fmt == "PNG" else _tiff(raw, w, h) if fmt == "TIFF" else None
    except (struct.error, zlib.error, KeyError, IndexError, ValueError, TypeError) as e:
        raise ImageError(f"broken image: {e}") from None
    if rgb is None:
        raise ImageError("JPEG bytes are decoded by the image source")
    bgr = rgb[:, :, [2, 1, 0, 3]] if alpha and rgb.shape[2] == 4 else rgb[:, :, 2::-1]
    return np.ascontiguousarray(bgr), fmt


def has_alpha(raw: bytes) -> bool:
    return raw.startswith(PNG) and raw[25:26] in (b"\x04", b"\x06")


def bare_jpeg(raw: bytes) -> bytes:
    """JPEG bytes without what rides along: comments, application data but for JFIF and Adobe's colour mark, bytes after the end."""
    out, at = bytearray(raw[:2]), 2
    try:
        while True:
            if raw[at] != 0xFF:
                raise ImageError("a marker is missing")
            kind = raw[at + 1]
            if kind == 0xFF:  # filling
                at += 1
                continue
            if kind == 0xD9:
                return bytes(out + b"\xff\xd9")
            (n,) = struct.unpack(">H", raw[at + 2:at + 4])
            end = at + 2 + n
            if n < 2 or end > len(raw):
                raise ImageError("a segment is cut off")
            if kind == 0xDA:  # coded pixels follow, up to a marker that is neither a restart nor a stuffed byte
                while True:
                    end = raw.index(b"\xff", end)
                    if raw[end + 1] == 0 or 0xD0 <= raw[end + 1] <= 0xD7:
                        end += 2
                    elif raw[end + 1] == 0xFF:
                        end += 1
                    else:
                        break
            if not (0xE1 <= kind <= 0xED or kind in (0xEF, 0xFE)):
                out += raw[at:end]
            at = end
    except (IndexError, ValueError, struct.error) as e:
        raise e if isinstance(e, ImageError) else ImageError("the end is missing") from None


#: First column and row, steps between columns and rows, of the passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png(raw: bytes, w: int, h: int) -> np.ndarray:
    bits, color, interlace = raw[24], raw[25], raw[28]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    at, parts, palette = 8, [], None
    while at + 8 <= len(raw):
        (n,) = struct.unpack(">I", raw[at:at + 4])
        kind, body = raw[at + 4:at + 8], raw[at + 8:at + 8 + n]
        if kind == b"IDAT":
            parts.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        at += 12 + n
    passes = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in PASSES if x < w and y < h] if interlace else [(0, 0, 1, 1, w, h)]
    width = lambda n: -(-n * channels * bits // 8)
    data, used = _inflate(b"".join(parts), sum(rows * (width(cols) + 1) for *_, cols, rows in passes)), 0
    a = np.zeros((h, w, channels), np.uint8)
    for x, y, dx, dy, cols, rows in passes:
        lines = unfilter(data[used:used + rows * (width(cols) + 1)], width(cols), max(1, channels * bits // 8), rows)
        used += rows * (width(cols) + 1)
        a[y::dy, x::dx] = samples(lines.tobytes(), rows, cols * channels, bits).reshape(rows, cols, channels)
    if color == 3:
        return palette[a[:, :, 0]]
    a = to_bytes(a, bits)
    return a if channels >= 3 else np.concatenate([np.repeat(a[:, :, :1], 3, axis=2), a[:, :, 1:]], axis=2)


def _inflate(raw: bytes, size: int) -> bytes:
    """At most `size` bytes, which is what the header states; no file can make more of its data."""
    try:
        return zlib.decompressobj().decompress(raw, max(1, size))
    except zlib.error as e:
        raise ImageError(str(e)) from e


def unfilter(data: bytes, row: int, pixel: int, rows: int, band: int = 512) -> np.ndarray:
    """Rows of bytes behind PNG's row filters.

    A row that is filtered by its left or upper left neighbours can't be done at once, but all pixels of an anti-diagonal can: what they
    need lies on the two anti-diagonals before. So `band` rows are undone together, in as many steps as a row has pixels, plus `band`.
    """
    a = np.frombuffer(data, np.uint8)[:rows * (row + 1)].reshape(rows, row + 1)
    if rows and a[:, 0].max() > 4:
        raise ImageError("unknown row filter")
    out = np.zeros((rows, row), np.uint8)
    above = np.zeros(row, np.uint8)
    y = 0
    while y < rows:
        kind = a[y, 0]
        if kind < 3:
            line = a[y, 1:]
            if kind == 1:
                line = line.copy()
                for k in range(pixel):
                    line[k::pixel] = np.cumsum(line[k::pixel], dtype=np.uint8)
            elif kind == 2:
                line = line + above
            out[y] = above = line
            y += 1
            continue
        end = min(rows, y + band)
        plain = np.flatnonzero(a[y:end, 0] < 3)
        end = y + int(plain[0]) if len(plain) and plain[0] > 16 else end  # rows without such neighbours are done faster by themselves
        _wavefront(a[y:end], out[y:end], above, pixel)
        above, y = out[end - 1], end
    return out


def _wavefront(a: np.ndarray, out: np.ndarray, above: np.ndarray, pixel: int) -> None:
    """Undo the filters of the rows a (kind first) below the row `above`; pixels are `pixel` bytes, of which a row's last may lack some."""
    n, row = out.shape
    columns = -(-row // pixel)
    padded = np.zeros((n, columns * pixel), np.uint8)
    padded[:, :row] = a[:, 1:]
    # line d of `skewed` is anti-diagonal d: of row r the pixel d - r
    skewed = np.zeros((columns + n, n, pixel), np.uint8)
    s0, s1, s2 = skewed.strides
    by_row = np.lib.stride_tricks.as_strided(skewed, (n, columns, pixel), (s0 + s1, s0, s2))
    by_row[...] = padded.reshape(n, columns, pixel)
    top = np.zeros((columns + 1, pixel), np.int16)  # the row above, behind a pixel of zeros
    top.reshape(-1)[pixel:pixel + row] = above
    kinds = a[:, 0]
    sub, up, average, paeth = (np.flatnonzero(kinds == k) for k in (1, 2, 3, 4))
    last, older = np.zeros((n + 1, pixel), np.int16), np.zeros((n + 1, pixel), np.int16)  # anti-diagonals d - 1 and d - 2; row r at r + 1
    for d in range(columns + n - 1):
        lo, hi = max(0, d - columns + 1), min(n, d + 1)
        last[0], older[0] = top[d + 1] if d < columns else 0, top[d] if d <= columns else 0  # above row 0: pixels d and d - 1
        guess = np.zeros((n, pixel), np.int16)
        left, upper, corner = last[1:], last[:-1], older[:-1]
        if len(sub):
            guess[sub] = left[sub]
        if len(up):
            guess[up] = upper[up]
        if len(average):
            guess[average] = (left[average] + upper[average]) >> 1
        if len(paeth):
            p, q, c = (left, upper, corner) if len(paeth) == n else (left[paeth], upper[paeth], corner[paeth])
            pa, pb = np.abs(q - c), np.abs(p - c)
            pc = np.abs(p + q - 2 * c)
            guess[paeth] = np.where((pa <= pb) & (pa <= pc), p, np.where(pb <= pc, q, c))
        now = np.zeros((n + 1, pixel), np.int16)
        now[lo + 1:hi + 1] = (skewed[d, lo:hi] + guess[lo:hi]) & 255
        skewed[d, lo:hi] = now[lo + 1:hi + 1]
        last, older = now, last
    out[...] = by_row.reshape(n, -1)[:, :row]


def _tiff(raw: bytes, w: int, h: int) -> np.ndarray:
    t = _tags(raw)
    channels, bits, packing = t.get(277, [1])[0], t.get(258, [1])[0], t.get(259, [1])[0]
    planes = channels if t.get(284, [1])[0] == 2 else 1
    each = channels // planes
    if any(b != bits for b in t.get(258, [1])) or t.get(266, [1])[0] != 1:
        raise ImageError("TIFF samples of several sizes or with low bits first aren't read")
    row = -(-w * each * bits // 8)
    high, data = min(h, t.get(278, [h])[0]), []
    strips = -(-h // high)
    for k, (at, n) in enumerate(zip(t[273], t[279])):
        rows = min(high, h - k % strips * high)
        strip = raw[at:at + n]
        if packing in (8, 32946):
            strip = _inflate(strip, rows * row)
        elif packing == 5:
            strip = lzw(strip, rows * row + 4096)
        elif packing == 32773:
            strip = run_lengths(strip, rows * row + 128, ends=False)
        elif packing != 1:
            raise ImageError("TIFF packing isn't read")
        if bits == 16 and raw[:2] == b"II":
            strip = np.frombuffer(strip, "<u2").astype(">u2").tobytes()
        if t.get(317, [1])[0] == 2:  # differences along a row
            kind = {8: np.dtype("u1"), 16: np.dtype(">u2")}.get(bits)
            if kind is None:
                raise ImageError("TIFF differences of small samples aren't read")
            line = np.frombuffer(strip, kind)[:rows * w * each].reshape(rows, w, each)
            strip = np.cumsum(line, axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()
        data.append(samples(strip, rows, w * each, bits).reshape(rows, w, each))
    a = np.concatenate([np.concatenate(data[p * strips:(p + 1) * strips]) for p in range(planes)], axis=2)
    meaning = t.get(262, [1])[0]
    if meaning == 3:
        return (np.array(t[320]).reshape(3, -1) >> 8).astype(np.uint8).T[a[:, :, 0]]
    a = to_bytes(a, bits)
    if channels < 3:
        a = np.repeat(a[:, :, :1], 3, axis=2)
        return 255 - a if meaning == 0 else a
    if meaning not in (2,):
        raise ImageError("only gray, palette and RGB colours of TIFF are read")
    return a[:, :, :3]


def encode(bgr: np.ndarray, fmt: str) -> bytes:
    """PNG or TIFF bytes of pixels; other formats become PNG, and so do pixels with alpha, the fourth channel."""
    alpha = bgr.shape[2] == 4
    rgb = np.ascontiguousarray(bgr[:, :, [2, 1, 0, 3]] if alpha else bgr[:, :, ::-1])
    h, w = rgb.shape[:2]
    if fmt == "TIFF" and not alpha:
        tags = [(256, 4, w), (257, 4, h), (258, 3, None), (259, 3, 1), (262, 3, 2), (273, 4, None), (277, 3, 3), (278, 4, h), (279, 4, w * h * 3)]
        body = 8 + 2 + 12 * len(tags) + 4
        out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
        for tag, kind, value in tags:
            count, value = (3, body) if tag == 258 else (1, body + 6) if tag == 273 else (1, value)
            out += struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 and count == 1 else struct.pack("<I", value))
        return out + struct.pack("<I", 0) + struct.pack("<HHH", 8, 8, 8) + rgb.tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], axis=1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
