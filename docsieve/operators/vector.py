"""Border shapes in the drawings of PDF pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..settings import DEFAULT, Settings

REASON = "opaque dark fill spanning page edge band"
PAGE = ["doc_id", "page_number"]


def border_shapes(drawings: DataFrame, pdf_pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Filled, opaque, dark drawings that reach into the edge band of their page and span much of it.

    drawings: doc_id, page_number, seq, rect, fill, fill_opacity. pdf_pages: doc_id, page_number, page_rect.
    Cheap conditions come before the join; the join is on document and page.
    """
    opacity = F.coalesce("fill_opacity", F.lit(1.0))
    dark = (drawings.where(F.col("fill").isNotNull() & (F.size("fill") > 0) & F.col("rect").isNotNull())
            .where((opacity >= settings.vector_min_opacity) & g.is_dark(F.col("fill"), settings.vector_darkness_threshold)))
    r, p = F.col("rect"), F.col("page_rect")
    return (dark.join(pdf_pages, PAGE)
            .where(g.touches_edge_band(r, p, settings.vector_edge_band_ratio) & g.spans_enough(r, p, settings.vector_min_span_ratio))
            .select("doc_id", "page_number", "seq", "rect", F.col("fill").alias("fill_color"), opacity.alias("opacity"), F.lit(REASON).alias("reason")))


CLIPS = "array<struct<even_odd:boolean,path:array<double>>>"


def pages_flagged(shapes: DataFrame) -> DataFrame:
    """Number of distinct flagged pages of each document."""
    return shapes.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages_flagged"))


def background_colors(shapes: DataFrame, drawings: DataFrame, pdf_pages: DataFrame) -> DataFrame:
    """Background of each flagged page: the top-most fill at the page's centre, white if a flagged shape covers it or none does.

    A fill covers the centre if its path winds around it, and so does every clip in force; drawings without a path are their rectangles.
    """
    centre = pdf_pages.select(*PAGE, ((F.col("page_rect")["x0"] + F.col("page_rect")["x1"]) / 2).alias("cx"),
                              ((F.col("page_rect")["y0"] + F.col("page_rect")["y1"]) / 2).alias("cy"))
    flagged = shapes.select(*PAGE).distinct().join(centre, PAGE)
    at = lambda r: g.contains(F.col(r), F.col("cx"), F.col("cy"))
    hidden = shapes.join(centre, PAGE).where(at("rect")).select(*PAGE).distinct()
    covers = at("rect")
    if "path" in drawings.columns:
        x, y = F.col("cx"), F.col("cy")
        clipped = F.forall(F.coalesce("clips", F.array().cast(CLIPS)), lambda c: g.inside(c["path"], c["even_odd"], x, y))
        covers = covers & F.when(F.col("path").isNull(), True).otherwise(g.inside(F.col("path"), F.col("even_odd"), x, y)) & clipped
    top = (drawings.where(F.size("fill") > 0).join(centre, PAGE).where(covers).groupBy(*PAGE)
           .agg(F.max_by("fill", "seq").alias("fill")))
    white = F.array(*[F.lit(1.0)] * 3)
    clear = flagged.select(*PAGE).join(hidden, PAGE, "left_anti").join(top, PAGE, "left")
    return (clear.select(*PAGE, F.coalesce("fill", white).alias("background"))
            .unionByName(hidden.select(*PAGE, white.alias("background"))))
