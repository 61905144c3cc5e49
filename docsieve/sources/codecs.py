"""Codings of samples that scanners use, in PDF and TIFF."""

from __future__ import annotations

import numpy as np


def lzw(data: bytes, most: int, early: int = 1) -> bytes:
    """Bytes behind LZW codes of 9 to 12 bits, high bits first. early: codes grow wider that many entries before they have to.

    More than `most` bytes are a ValueError.
    """
    known = [bytes([k]) for k in range(256)] + [b"", b""]
    out, last, width, held, bits = bytearray(), b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del known[258:]
            last, width = b"", 9
            continue
        if code > len(known) or code == len(known) and not last:
            raise ValueError("an LZW code is unknown")
        now = known[code] if code < len(known) else last + last[:1]
        if last and len(known) < 4096:
            known.append(last + now[:1])
        out += now
        if len(out) > most:
            raise ValueError("a stream inflates past the safe limit")
        last, width = now, min(12, max(9, (len(known) + early).bit_length()))
    return bytes(out)


def run_lengths(data: bytes, most: int, ends: bool) -> bytes:
    """Bytes behind run lengths; 128 ends the data (PDF) or means nothing (TIFF). More than `most` bytes are a ValueError."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at:at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at:at + 1] * (257 - n)
            at += 1
        elif ends:
            break
        if len(out) > most:
            raise ValueError("a stream inflates past the safe limit")
    return bytes(out)


def samples(data: bytes, rows: int, count: int, bits: int) -> np.ndarray:
    """rows x count samples of 1, 2, 4, 8 or 16 bits, rows beginning at whole bytes; of 16 bits the upper 8 (high byte first)."""
    row = -(-count * bits // 8)
    a = np.frombuffer(data, np.uint8)[:rows * row].reshape(rows, row)
    if bits == 8:
        return a
    if bits == 16:
        return a[:, ::2]
    if bits not in (1, 2, 4):
        raise ValueError(f"samples of {bits} bits aren't read")
    each = np.unpackbits(a, axis=1).reshape(rows, -1, bits)
    return (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :count]


def to_bytes(a: np.ndarray, bits: int) -> np.ndarray:
    """Samples of fewer than 8 bits on the scale of 8."""
    return (a.astype(np.int32) * 255 // ((1 << bits) - 1)).astype(np.uint8) if bits < 8 else a
