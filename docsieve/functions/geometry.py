"""Expressions over rectangles (struct of x0, y0, x1, y1: double) and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def is_dark(fill: Column, most: float) -> Column:
    """Whether the luma of an RGB colour (array of doubles) is at most `most`; null colours aren't dark."""
    luma = F.lit(0.299) * fill[0] + F.lit(0.587) * fill[1] + F.lit(0.114) * fill[2]
    return F.coalesce(luma <= most, F.lit(False))


def touches_edge_band(r: Column, page: Column, band: float) -> Column:
    """Whether a rectangle reaches into the band along any side of the page."""
    bx, by = width(page) * band, height(page) * band
    return ((r["x0"] <= page["x0"] + bx) | (r["x1"] >= page["x1"] - bx) | (r["y0"] <= page["y0"] + by) | (r["y1"] >= page["y1"] - by))


def spans_enough(r: Column, page: Column, least: float) -> Column:
    """Whether a rectangle is long enough in either direction; a page without extent has no spans."""
    share = lambda a, b: F.when(b != 0, a / b).otherwise(F.lit(0.0))
    return (share(width(r), width(page)) >= least) | (share(height(r), height(page)) >= least)


def area_qualifies(r: Column, page: Column, least: float, most: float) -> Column:
    """Whether the share of the page's area lies in [least, most]; pages without area have no candidates."""
    area = width(page) * height(page)
    return F.when(area > 0, (width(r) * height(r) / area).between(least, most)).otherwise(F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Whether two rectangles share more than a border."""
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def contains(outer: Column, x: Column, y: Column) -> Column:
    return (outer["x0"] <= x) & (x < outer["x1"]) & (outer["y0"] <= y) & (y < outer["y1"])


def winding(path: Column, x: Column, y: Column) -> Column:
    """How often the segments of a path go around a point: crossings of the ray to its right, downward ones less upward ones.

    path: array of doubles, four a segment (x0, y0, x1, y1).
    """
    def crossing(i: Column) -> Column:
        x0, y0, x1, y1 = (F.get(path, 4 * i + k) for k in range(4))
        right = x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)
        return F.when((y0 <= y) & (y < y1) & right, 1).when((y1 <= y) & (y < y0) & right, -1).otherwise(0)

    n = F.coalesce(F.floor(F.size(path) / 4), F.lit(0)).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), lambda acc, i: acc + crossing(i))


def inside(path: Column, even_odd: Column, x: Column, y: Column) -> Column:
    """Whether a fill of the path covers a point, by the rule that its operator names."""
    turns = winding(path, x, y)
    return F.when(F.coalesce(even_odd, F.lit(False)), turns % 2 != 0).otherwise(turns != 0)


def tolerance_dedupe(items: Column, tolerances: tuple[float, float, float, float], item_type: str) -> Column:
    """Items (structs with a field rect) without those near one kept before: all four coordinates differ by less than the tolerances.

    First wins, and nearness isn't transitive, so this is a fold in the array's order.
    """
    sides = ("x0", "y0", "x1", "y1")

    def near(a: Column, b: Column) -> Column:
        out = F.lit(True)
        for side, tolerance in zip(sides, tolerances):
            out = out & (F.abs(a["rect"][side] - b["rect"][side]) < tolerance)
        return out

    return F.aggregate(items, F.array().cast(f"array<{item_type}>"),
                       lambda acc, x: F.when(F.exists(acc, lambda k: near(k, x)), acc).otherwise(F.array_append(acc, x)))


#: Cells of level k are squares of CELL * 2**k; rectangles beyond the top level's reach are held to it.
CELL, LEVELS = 16.0, 16
_REACH = CELL * 2 ** (LEVELS - 1)


def level(r: Column) -> Column:
    """The finest level at which a rectangle meets two columns and two rows of cells at most."""
    longest = F.greatest(width(r), height(r), F.lit(CELL))
    return F.least(F.ceil(F.log2(longest / CELL)), F.lit(LEVELS - 1)).cast("int")


def _index(v: Column, at: Column) -> Column:
    held = F.greatest(F.least(v, F.lit(_REACH)), F.lit(-_REACH))
    return F.floor(held / (F.lit(CELL) * F.pow(F.lit(2.0), at)))


def in_cells(rows: DataFrame, r: str, levels: Column) -> DataFrame:
    """rows once for each cell that the rectangle r meets at each of these levels: cell_level, cell_x, cell_y."""
    at, col = F.col("cell_level"), F.col(r)
    return (rows.withColumn("cell_level", F.explode(levels))
            .withColumn("cell_x", F.explode(F.sequence(_index(col["x0"], at), _index(col["x1"], at))))
            .withColumn("cell_y", F.explode(F.sequence(_index(col["y0"], at), _index(col["y1"], at)))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """All pairs of rows of left and right with equal keys whose rectangles a and b overlap, each pair once.

    A pair meets at the coarser of its two levels, in the cell that has the upper left corner of what the rectangles share. So rows are
    joined by key and cell, not by key alone: what a row is held against lies near it, however many rows its key has. Both joins sort, for
    the reason in operators.audit._met.
    """
    cells = ["cell_level", "cell_x", "cell_y"]
    left = left.withColumn("level_a", level(F.col(a)))
    there = left.groupBy(*keys).agg(F.collect_set("level_a").alias("levels"))  # LEVELS numbers a key at most
    right = right.join(there.hint("merge"), keys).withColumn("level_b", level(F.col(b)))  # of keys without a rectangle at the left, nothing goes on
    upward = F.sequence(F.col("level_a"), F.lit(LEVELS - 1))
    own = F.array_union(F.array("level_b"), F.filter("levels", lambda x: x > F.col("level_b")))
    pairs = in_cells(left, a, upward).join(in_cells(right, b, own).drop("levels").hint("merge"), [*keys, *cells])
    x, y = F.greatest(F.col(a)["x0"], F.col(b)["x0"]), F.greatest(F.col(a)["y0"], F.col(b)["y0"])
    at = F.col("cell_level")
    owner = (F.col("cell_x") == _index(x, at)) & (F.col("cell_y") == _index(y, at))
    return pairs.where((at == F.greatest("level_a", "level_b")) & owner & overlap(F.col(a), F.col(b))).drop(*cells, "level_a", "level_b")
