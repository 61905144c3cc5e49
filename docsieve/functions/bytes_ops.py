"""Expressions over file bytes: guards, kinds, forbidden tokens, revision boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings

#: The prefixes that tell a file's kind, in order of test.
MAGIC = (
    ("255044462D", "pdf"),  # %PDF-
    ("89504E470D0A1A0A", "raster_image"),  # PNG
    ("FFD8FF", "raster_image"),  # JPEG
    ("49492A00", "raster_image"),  # TIFF, little-endian
    ("4D4D002A", "raster_image"),  # TIFF, big-endian
)
#: Names of active content, as they are reported. Only /JS must end where the word does.
TOKENS = ("/JavaScript", r"/JS\b", "/Launch", "/OpenAction", "/EmbeddedFile", "/RichMedia", "/SubmitForm", "/ImportData", "/GoToR", "/GoToE")

ERROR_EMPTY = "Empty file."
ERROR_KIND = "Unrecognized or unsupported file type."


def too_large(settings: Settings) -> str:
    return f"File exceeds maximum allowed size of {settings.max_upload_bytes} bytes."


def latin1(content: Column) -> Column:
    """Bytes as a string of as many characters."""
    return F.decode(content, "ISO-8859-1")


def size_error(length: Column, settings: Settings = DEFAULT) -> Column:
    """Why a file of this many bytes is refused, or null; the limit itself passes."""
    return F.when(length == 0, ERROR_EMPTY).when(length > settings.max_upload_bytes, too_large(settings))


def kind_of(content: Column) -> Column:
    """'pdf', 'raster_image' or null, by the first prefix that fits at offset 0."""
    case = F
    for prefix, kind in MAGIC:
        case = case.when(F.startswith(content, F.unhex(F.lit(prefix))), F.lit(kind))
    return case.otherwise(F.lit(None).cast("string"))


def forbidden_tokens(text: Column, tokens: tuple[str, ...] = TOKENS) -> Column:
    """Sorted array of the tokens found. A word ends before all but ASCII letters, digits and _, whatever the locale."""
    def pattern(token: str) -> str:
        bare = token.removesuffix(r"\b")
        return "\\Q" + bare + "\\E" + ("(?![0-9A-Za-z_])" if bare != token else "")

    plain = [F.when(F.contains(text, F.lit(t)), F.lit(t)) if not t.endswith(r"\b") else F.when(text.rlike(pattern(t)), F.lit(t)) for t in tokens]
    return F.array_sort(F.array_compact(F.array(*plain)))


def token_error(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.concat(F.lit("Document rejected: contains disallowed active content ("), F.array_join(hits, ", "), F.lit(").")))


def boundary_offsets(text: Column, pattern: str = r"startxref\s+[0-9]+\s*%%EOF", most: int = DEFAULT.forensics_max_boundary_candidates) -> Column:
    """End offsets (exclusive, ascending) of the first `most` places of a pattern in a string of one character a byte.

    The string is cut into stretches that each end with a match; running sums of their lengths are the offsets. \\G holds each
    stretch to the end of the one before, so what follows the last match is read once and not from every place in it.
    """
    pieces = F.slice(F.regexp_extract_all(text, F.lit(f"(?s)\\G(.*?{pattern})"), F.lit(1)), 1, most)
    return F.aggregate(
        pieces, F.array().cast("array<long>"),
        lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + F.length(x)))


def base64_plain(content: Column) -> Column:
    """Base64 without line breaks."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
