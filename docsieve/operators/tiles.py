"""Connected components of pictures by tiles, so that no task holds the labels of a whole picture.

A picture is cut into tiles that share a line of pixels with the next ones. Each tile is labelled by itself; a run of pixels on a shared
line is the same run in both tiles, so its two labels belong together. These pairs, as many as there are runs on shared lines, are joined
to components picture by picture; what was found in a tile is then added up by component. Free space is treated likewise (by its four
neighbours), which tells components in a hole of others from those that can be reached from outside.

tiles: doc_id, tile (its number), y, x (of its first pixel), height, width (of the picture), rows, columns (shared lines included), mask
(a byte a pixel).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..settings import DEFAULT, Settings
from ..sources.files import by_row
from ..storage import materialize

_TILE = dict.fromkeys(("tile", "y", "x", "height", "width", "rows", "columns"), pa.int32()) | {"mask": pa.binary()}
#: kind 0 is free space, 1 the mask. Nodes are labels of tiles, with numbers that are unique in a picture.
_PART = pa.struct([(c, pa.int64()) for c in ("kind", "node", "x0", "y0", "x1", "y1")] + [("border", pa.bool_())])
_RUN = pa.struct([(c, pa.int64()) for c in ("kind", "down", "line", "start", "node")])
_TOUCH = pa.struct([("mask", pa.int64()), ("free", pa.int64())])


def _sql(t: pa.StructType) -> str:
    return "array<struct<" + ",".join(f"{f.name}:{'boolean' if f.type == pa.bool_() else 'bigint'}" for f in t) + ">>"


def cut(images: DataFrame, size: int = 1024, settings: Settings = DEFAULT, radius: int = 4) -> DataFrame:
    """Tiles of decoded images (doc_id, height, width, channels, data): dark pixels, closed as pixels.close_mask does with this radius.

    Closing looks twice its radius far, so a tile's mask is worked out with that much around it, and is the whole picture's.
    """
    def make(doc_id, h: int, w: int, c: int, data: bytes) -> Iterable[tuple]:
        bgr, number = pixels.to_bgr(data, h, w, c), 0
        for y in range(0, max(1, h - 1), size):  # the last line lies in the tile before it
            for x in range(0, max(1, w - 1), size):
                y1, x1, top, left = min(h, y + size + 1), min(w, x + size + 1), max(0, y - 2 * radius), max(0, x - 2 * radius)
                dark = pixels.gray(bgr[top:y1 + 2 * radius, left:x1 + 2 * radius]) <= settings.raster_mean_intensity_max
                mask = (pixels.close_mask(dark, radius) if radius else dark)[y - top:y1 - top, x - left:x1 - left]
                yield doc_id, number, y, x, h, w, y1 - y, x1 - x, mask.astype(np.uint8).tobytes()
                number += 1

    kind = images.schema["doc_id"].dataType.simpleString()
    return images.select("doc_id", "height", "width", "channels", "data").mapInArrow(
        by_row(make, {"doc_id": None, **_TILE}), f"doc_id {kind}, tile int, y int, x int, height int, width int, rows int, columns int, mask binary")


def _runs(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, label) of the runs of a line of labels that aren't 0."""
    start = np.flatnonzero((labels > 0) & np.r_[True, labels[1:] != labels[:-1]])
    return start, labels[start]


def label_tile(tile: int, y: int, x: int, h: int, w: int, mask: np.ndarray) -> tuple[list[dict], list[dict], list[dict]]:
    """(parts, runs on shared lines, pairs of mask and free parts that touch) of a tile."""
    parts, runs, nodes = [], [], []
    for kind, labels in enumerate((pixels.components(~mask, corners=False), pixels.components(mask))):
        base = (np.int64(tile) << 33) | (np.int64(kind) << 32)
        nodes.append(np.where(labels > 0, base | labels, -1))
        ys, xs = np.nonzero(labels)
        of = labels[ys, xs]
        order = np.argsort(of, kind="stable")
        ys, xs, of = ys[order], xs[order], of[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        if len(of):
            at_border = (ys + y == 0) | (xs + x == 0) | (ys + y == h - 1) | (xs + x == w - 1)
            box = (np.minimum.reduceat(xs, first) + x, np.minimum.reduceat(ys, first) + y, np.maximum.reduceat(xs, first) + x, np.maximum.reduceat(ys, first) + y)
            for row in zip((base | of[first]).tolist(), *(v.tolist() for v in box), np.logical_or.reduceat(at_border, first).tolist()):
                parts.append({"kind": kind, **dict(zip(("node", "x0", "y0", "x1", "y1", "border"), row))})
        # the first line of a tile is the last one of the tile before, unless the picture begins or ends there
        rows, columns = mask.shape
        lines = [(0, y, labels[0], x)] * (y > 0) + [(0, y + rows - 1, labels[-1], x)] * (y + rows < h)
        lines += [(1, x, labels[:, 0], y)] * (x > 0) + [(1, x + columns - 1, labels[:, -1], y)] * (x + columns < w)
        for down, line, own, offset in lines:
            for start, label in zip(*(v.tolist() for v in _runs(own))):
                runs.append({"kind": kind, "down": down, "line": line, "start": start + offset, "node": int(base | label)})
    free, held = nodes
    touch = [np.stack([held[a], free[b]], -1).reshape(-1, 2) for a, b in (
        (np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:]))]
    pairs = np.concatenate(touch)
    pairs = np.unique(pairs[(pairs >= 0).all(axis=1)], axis=0)
    return parts, runs, [{"mask": a, "free": b} for a, b in pairs.tolist()]


def _union(t: pa.Table) -> pa.Table:
    """The least node of each node's component, from pairs (a, b) of one picture."""
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    names, code = np.unique(np.r_[a, b], return_inverse=True)
    a, b = np.split(code, 2)
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]  # and on to the least node that is known of that one
        if (low == label).all():
            break
        label = low
    at = pa.array(np.zeros(len(names), np.int64))
    return pa.table({"doc_id": t.column("doc_id").take(at), "node": names, "root": names[label]})


def boxes(tiles: DataFrame, outer: bool = True) -> DataFrame:
    """(doc_id, x, y, w, h) of the components of each picture's mask; outer: only of those that no other one encloses.

    What meets in a task for a picture are the runs on its shared lines, not its pixels.
    """
    kind = tiles.schema["doc_id"].dataType.simpleString()

    def make(doc_id, tile: int, y: int, x: int, h: int, w: int, rows: int, columns: int, data: bytes) -> Iterable[tuple]:
        yield doc_id, *label_tile(tile, y, x, h, w, np.frombuffer(data, np.uint8).reshape(rows, columns) > 0)

    run = by_row(make, {"doc_id": None, "parts": pa.list_(_PART), "runs": pa.list_(_RUN), "touch": pa.list_(_TOUCH)}, rows=16)
    found = materialize(tiles.select("doc_id", *_TILE).mapInArrow(run, f"doc_id {kind}, parts {_sql(_PART)}, runs {_sql(_RUN)}, touch {_sql(_TOUCH)}"))
    rel = lambda c: found.select("doc_id", F.explode(c).alias("r")).select("doc_id", "r.*")
    same = Window.partitionBy("doc_id", "kind", "down", "line", "start")  # four rows at most, where four tiles meet
    pairs = rel("runs").select("doc_id", F.min("node").over(same).alias("a"), F.col("node").alias("b")).where("a < b").distinct()
    roots = materialize(pairs.groupBy("doc_id").applyInArrow(_union, f"doc_id {kind}, node long, root long"))
    rooted = lambda df, c: df.join(roots.withColumnsRenamed({"node": c, "root": f"{c}_root"}), ["doc_id", c], "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    whole = rooted(rel("parts"), "node").groupBy("doc_id", "kind", "node").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("border").alias("border"))
    held = whole.where("kind = 1")
    if outer:
        open_space = whole.where("kind = 0 and border").select("doc_id", F.col("node").alias("free"))
        seen = rooted(rooted(rel("touch"), "mask"), "free").distinct().join(open_space, ["doc_id", "free"]).select("doc_id", F.col("mask").alias("node")).distinct()
        held = held.join(seen.withColumn("seen", F.lit(True)), ["doc_id", "node"], "left").where("border or seen")
    one = lambda c: c.cast("int")
    return held.select("doc_id", one(F.col("x0")).alias("x"), one(F.col("y0")).alias("y"), one(F.col("x1") - F.col("x0") + 1).alias("w"), one(F.col("y1") - F.col("y0") + 1).alias("h"))
