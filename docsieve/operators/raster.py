"""Border bars among the dark components of page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings

SIDES = ("left", "right", "top", "bottom")
EDGE_TOLERANCE = 0.03
MIN_EDGE_FRACTION = 0.05


def side_of(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column, tolerance: float = EDGE_TOLERANCE) -> Column:
    """The first side, in the order left, right, top, bottom, that a component lies at; else 'interior'."""
    return (F.when(x <= img_w * tolerance, "left").when(x + w >= img_w * (1 - tolerance), "right")
            .when(y <= img_h * tolerance, "top").when(y + h >= img_h * (1 - tolerance), "bottom").otherwise("interior"))


def border_components(components: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Components at a side that are long, thin, dark and, where edge_fraction is given, crisp enough, with their side.

    components: doc_id, x, y, w, h, img_w, img_h, mean_intensity, and edge_fraction (optional).
    """
    c = F.col
    upright = c("side").isin("left", "right")
    span = F.when(upright, c("h") / c("img_h")).otherwise(c("w") / c("img_w"))
    thickness = F.when(upright, c("w") / c("img_w")).otherwise(c("h") / c("img_h"))
    keep = ((c("side") != "interior") & (span >= settings.raster_min_span_ratio) & (thickness <= settings.raster_max_thickness_ratio)
            & (c("w") > 0) & (c("h") > 0) & (c("mean_intensity") <= settings.raster_mean_intensity_max))
    if "edge_fraction" in components.columns:
        keep = keep & (c("edge_fraction") >= MIN_EDGE_FRACTION)
    return components.withColumn("side", side_of(*map(c, ("x", "y", "w", "h", "img_w", "img_h")))).where(keep)


def merge_by_side(flagged: DataFrame) -> DataFrame:
    """One band of full length for each document and side: doc_id, x, y, w, h, side, mean_intensity, side_order."""
    c = F.col
    per = flagged.groupBy("doc_id", "side").agg(
        F.max(c("x") + c("w")).alias("right"), F.min("x").alias("left"), F.max(c("y") + c("h")).alias("bottom"), F.min("y").alias("top"),
        F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"), F.avg("mean_intensity").alias("mean_intensity"))
    s = c("side")
    return per.select(
        "doc_id", F.when(s == "right", c("left")).otherwise(F.lit(0)).cast("int").alias("x"),
        F.when(s == "bottom", c("top")).otherwise(F.lit(0)).cast("int").alias("y"),
        F.when(s == "left", c("right")).when(s == "right", c("img_w") - c("left")).otherwise(c("img_w")).cast("int").alias("w"),
        F.when(s == "top", c("bottom")).when(s == "bottom", c("img_h") - c("top")).otherwise(c("img_h")).cast("int").alias("h"),
        "side", "mean_intensity", F.array_position(F.array(*map(F.lit, SIDES)), s).cast("int").alias("side_order"))


def channel_median(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median of a channel for each key, cut to an integer; null where a key has no values.

    A histogram is enough: values are counted in tasks first and then added up, so a key of any number of pixels is as many rows as it
    has different values (256 for a channel of bytes), and nothing is sorted but these.
    """
    counts = pixels.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    own = Window.partitionBy(*keys)
    counts = counts.withColumns({"_up_to": F.sum("_n").over(own.orderBy("_v")), "_all": F.sum("_n").over(own)})
    at = lambda when: F.min(F.when(when, F.col("_v")))
    low, high = at(2 * F.col("_up_to") >= F.col("_all")), at(2 * F.col("_up_to") > F.col("_all"))
    return counts.groupBy(*keys).agg(F.floor((low + high) / 2).cast("long").alias("median"))
