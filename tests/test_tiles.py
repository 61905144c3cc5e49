"""Components by tiles, against those of the whole picture."""

import numpy as np
import pytest

from docsieve.functions import pixels
from docsieve.operators import tiles


def _pictures(rng):
    out = []
    for k in range(24):
        h, w = int(rng.integers(1, 90)), int(rng.integers(1, 90))
        a = np.full((h, w), 255, np.uint8)
        for _ in range(int(rng.integers(0, 9))):
            y, x, dy, dx = (int(rng.integers(0, n)) for n in (h, w, 40, 40))
            a[y:y + dy, x:x + dx] = 0
            if k % 3 == 0:  # rings with something inside
                a[y + 3:y + dy - 3, x + 3:x + dx - 3] = 255
                a[y + 9:y + dy - 9, x + 9:x + dx - 9] = 0
        if k % 4 == 1:
            a[rng.random((h, w)) < 0.45] = 0
        out.append(np.repeat(a[:, :, None], 3, axis=2))
    out += [np.zeros((70, 70, 3), np.uint8), np.full((70, 70, 3), 255, np.uint8)]
    snake = np.full((65, 65, 3), 255, np.uint8)
    for y in range(0, 65, 4):
        snake[y] = 0
        if y < 64:
            snake[y:y + 5, 64 if y % 8 == 0 else 0] = 0
    return [*out, snake]


@pytest.mark.parametrize("size, radius", [(64, 4), (64, 0), (7, 0), (16, 2), (1, 0)])
def test_boxes_by_tiles_equal_those_of_whole_pictures(spark, size, radius):
    pictures = _pictures(np.random.default_rng(17))
    pictures = pictures if size > 1 else [p[:9, :9] for p in pictures]
    df = spark.createDataFrame([(k, *p.shape, p.tobytes()) for k, p in enumerate(pictures)], "doc_id int, height int, width int, channels int, data binary")
    cut = tiles.cut(df, size, radius=radius)
    masks = [pixels.close_mask(p[:, :, 0] <= 60, radius) if radius else p[:, :, 0] <= 60 for p in pictures]
    for outer in (True, False):
        got = {k: [] for k in range(len(pictures))}
        for r in tiles.boxes(cut, outer).collect():
            got[r["doc_id"]].append((r["x"], r["y"], r["w"], r["h"]))
        for k, mask in enumerate(masks):
            if outer:
                want = pixels.outer_boxes(mask)
            else:
                labels = pixels.components(mask)
                at = [np.nonzero(labels == n) for n in range(1, labels.max() + 1)]
                want = [(int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1) for y, x in at]
            assert sorted(got[k]) == sorted(want), (k, outer)


def test_components_without_corners():
    mask = np.array([[1, 0, 1], [0, 1, 1], [1, 0, 0]], bool)
    assert pixels.components(mask).max() == 1 and pixels.components(mask, corners=False).max() == 3


def test_no_pictures(spark):
    none = spark.createDataFrame([], "doc_id int, height int, width int, channels int, data binary")
    assert tiles.boxes(tiles.cut(none)).count() == 0
