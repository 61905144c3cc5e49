import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsieve.functions import bytes_ops as b
from docsieve.functions import geometry as g
from docsieve.operators import audit, raster, vector
from docsieve.settings import DEFAULT, Settings


def values(df, col):
    return [r[col] for r in df.collect()]


def test_size_guard_limits_are_inclusive(spark):
    s = Settings(max_upload_bytes=10)
    df = spark.createDataFrame([(0,), (10,), (11,)], "n int").select(b.size_error(F.col("n"), s).alias("e"))
    assert values(df, "e") == [b.ERROR_EMPTY, None, b.too_large(s)]


def test_kinds_by_prefix_at_offset_zero(spark):
    raw = [b"%PDF-1.4", b"\x89PNG\r\n\x1a\n..", b"\xff\xd8\xff\xe0", b"II*\0", b"MM\0*", b"x%PDF-", b"", None]
    df = spark.createDataFrame([(bytearray(r) if r is not None else None,) for r in raw], "c binary").select(b.kind_of(F.col("c")).alias("k"))
    assert values(df, "k") == ["pdf", "raster_image", "raster_image", "raster_image", "raster_image", None, None, None]


def test_tokens_end_where_ascii_words_end(spark):
    raw = [b"/JS(", b"/JS\xe9", b"/JSON", b"/LaunchX /EmbeddedFiles", b"/GoToR /GoToE /JavaScript", b"none"]
    df = spark.createDataFrame([(bytearray(r),) for r in raw], "c binary").select(b.forbidden_tokens(b.latin1(F.col("c"))).alias("t"))
    assert values(df, "t") == [[r"/JS\b"], [r"/JS\b"], [], ["/EmbeddedFile", "/Launch"], ["/GoToE", "/GoToR", "/JavaScript"], []]


def test_boundaries_equal_finditer(spark):
    rng = random.Random(5)
    parts = [b"startxref", b" ", b"\n", b"12", b"%%EOF", b"x", b"\xe9", b"startxref\n7\n%%EOF"]
    raw = [b"".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame([(bytearray(r),) for r in raw], "c binary").select(b.boundary_offsets(b.latin1(F.col("c")), most=5).alias("o"))
    pattern = re.compile(rb"startxref\s+(\d+)\s*%%EOF")
    assert values(df, "o") == [[m.end() for m in pattern.finditer(r)][:5] for r in raw]


def test_tolerance_dedupe_is_first_wins_and_not_transitive(spark):
    rng = random.Random(3)
    groups = [[(k, *(rng.uniform(0, 6) for _ in range(4))) for k in range(rng.randint(1, 12))] for _ in range(60)]
    groups.append([(0, 0.0, 0, 0, 0), (1, 1.5, 0, 0, 0), (2, 3.0, 0, 0, 0), (3, 2.0, 0, 0, 0)])

    def loop(items):
        kept = []
        for it in items:
            if not any(all(abs(p - q) < 2.0 for p, q in zip(it[1:], k[1:])) for k in kept):
                kept.append(it)
        return [k[0] for k in kept]

    rows = [(i, 0, k, dict(zip(("x0", "y0", "x1", "y1"), map(float, r))), "vector_fill") for i, items in enumerate(groups) for k, *r in items]
    df = spark.createDataFrame(rows, f"doc_id int, page_number int, seq int, rect {g.RECT}, source string")
    got = {}
    for r in audit.dedupe(df).collect():
        got.setdefault(r["doc_id"], []).append(r["seq"])
    assert {k: sorted(v) for k, v in got.items()} == {i: loop(items) for i, items in enumerate(groups)}
    assert loop(groups[-1]) == [0, 2] or loop(groups[-1]) == [0, 2, 3][:2]


def shapes(spark, rows):
    """Rows of (x0, y0, x1, y1, gray, opacity) on a page of 100 x 100."""
    d = [(k, 0, k, dict(zip(("x0", "y0", "x1", "y1"), map(float, r[:4]))) if r[0] is not None else None, None if r[4] is None else [r[4]] * 3, r[5]) for k, r in enumerate(rows)]
    drawings = spark.createDataFrame(d, f"doc_id int, page_number int, seq int, rect {g.RECT}, fill array<double>, fill_opacity double")
    pages = spark.createDataFrame([(k, 0, (0.0, 0.0, 100.0, 100.0)) for k in range(len(rows))], f"doc_id int, page_number int, page_rect {g.RECT}")
    return drawings, pages


def test_border_shapes_on_both_sides_of_each_threshold(spark):
    rows = [(0, 0, 10, 55, 0.0, None), (0, 0, 10, 54.9, 0.0, None), (12, 20, 20, 80, 0.0, 1.0), (12.1, 13, 80, 87, 0.0, 1.0), (0, 0, 10, 60, 0.25, 0.85),
            (0, 0, 10, 60, 0.26, 1.0), (0, 0, 10, 60, 0.0, 0.84), (0, 0, 10, 60, 0.0, 0.0), (0, 0, 10, 60, None, 1.0), (None, 0, 0, 0, 0.0, 1.0), (0, 0, 100, 100, 0.0, 1.0)]
    d, p = shapes(spark, rows)
    # the last, a dark background of the whole page, is flagged: there is no limit of thickness
    assert sorted(r["seq"] for r in vector.border_shapes(d, p).collect()) == [0, 2, 4, 10]


def test_audit_counts_opacity_zero_as_opaque(spark):
    d, p = shapes(spark, [(10, 10, 20, 20, 0.0, 0.0), (10, 10, 20, 20, 0.0, 0.5), (10, 10, 10.5, 10.5, 0.0, 1.0), (0, 0, 100, 86, 0.0, 1.0), (0, 0, 100, 85, 0.3, 1.0), (5, 5, 20, 20, 0.31, 1.0)])
    assert sorted(r["seq"] for r in audit.vector_candidates(d, p).collect()) == [0, 4]


def test_pages_without_area_have_no_candidates(spark):
    page = g.rect(*[F.lit(0)] * 4)
    r = g.rect(*map(F.lit, (0, 0, 1, 1)))
    row = spark.range(1).select(g.area_qualifies(r, page, 0.0, 1.0).alias("a"), g.spans_enough(r, page, 0.5).alias("s")).first()
    assert (row["a"], row["s"]) == (False, False)


def test_flat_images(spark):
    rows = [(k, 0, 0, (10.0, 10.0, 30.0, 30.0), v, m) for k, (v, m) in enumerate([(12.0, 178.5), (12.1, 10.0), (0.0, 178.6), (None, None)])]
    i = spark.createDataFrame(rows, f"doc_id int, page_number int, seq int, rect {g.RECT}, variance double, mean_intensity double")
    pages = spark.createDataFrame([(k, 0, (0.0, 0.0, 100.0, 100.0)) for k in range(4)], f"doc_id int, page_number int, page_rect {g.RECT}")
    assert [r["doc_id"] for r in audit.image_candidates(i, pages).collect()] == [0]


def test_sides_are_tested_left_first(spark):
    # a bar over the full width at the top is "left", fails the span and is never flagged; an inset one is found; a frame isn't
    comps = [(0, 0, 0, 1000, 30), (1, 40, 0, 900, 30), (2, 0, 0, 1000, 800), (3, 0, 0, 50, 800), (4, 400, 300, 100, 100)]
    df = spark.createDataFrame([(*c, 1000, 800, 10.0, 0.5) for c in comps], "doc_id int, x int, y int, w int, h int, img_w int, img_h int, mean_intensity double, edge_fraction double")
    assert sorted((r["doc_id"], r["side"]) for r in raster.border_components(df).collect()) == [(1, "top"), (3, "left")]
    soft = df.withColumn("edge_fraction", F.lit(0.04))
    assert raster.border_components(soft).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 60)] * 4), min_size=1, max_size=8))
def test_merged_bands_cover_their_parts(rows):
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    if spark is None:
        return
    data = [(0, x, y, w + 1, h + 1, 100, 100, 5.0, "left") for x, y, w, h in rows]
    df = spark.createDataFrame(data, "doc_id int, x int, y int, w int, h int, img_w int, img_h int, mean_intensity double, side string")
    band = raster.merge_by_side(df).first()
    assert (band["x"], band["y"], band["h"]) == (0, 0, 100) and band["w"] == max(x + w + 1 for x, _, w, _ in rows)


def test_settings_from_environment():
    s = Settings.from_env({"MAX_PDF_PAGES": "7", "AUDIT_MIN_OPACITY": "0.5", "AUDIT_ANY_SOLID_COLOR": "Yes", "STRICT": "0"})
    assert (s.max_pdf_pages, s.audit_min_opacity, s.audit_any_solid_color, s.strict) == (7, 0.5, True, False)
    assert Settings.from_env({}) == DEFAULT
