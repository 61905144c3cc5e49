"""What lies at a page's centre: winding numbers, holes, clips, curves."""

import random

import pytest
from pyspark.sql import functions as F

from docsieve.functions import geometry as g
from docsieve.operators import vector
from docsieve.sources import files as fs

from . import pdfs

BAR = b"0 g 0 0 40 792 re f\n"
GRAY = b"0.5 g "
CASES = {
    "whole": (GRAY + b"100 100 400 600 re f", 0.5),
    "L around the centre": (GRAY + b"100 100 m 500 100 l 500 200 l 200 200 l 200 700 l 100 700 l f", 1.0),
    "hole by even-odd": (GRAY + b"100 100 400 600 re 200 200 200 400 re f*", 1.0),
    "no hole, same turn": (GRAY + b"100 100 400 600 re 200 200 200 400 re f", 0.5),
    "hole by turning back": (GRAY + b"100 100 400 600 re 200 200 m 200 600 l 400 600 l 400 200 l f", 1.0),
    "hole over another fill": (b"0.8 g 0 0 612 792 re f " + GRAY + b"100 100 400 600 re 200 200 200 400 re f*", 0.8),
    "clipped away": (b"q 0 0 100 100 re W n " + GRAY + b"0 0 612 792 re f Q", 1.0),
    "clip with the centre": (b"q 200 300 200 200 re W n " + GRAY + b"0 0 612 792 re f Q", 0.5),
    "clip ends with its state": (b"q 0 0 100 100 re W n Q " + GRAY + b"0 0 612 792 re f", 0.5),
    "clip with a hole": (b"q 100 100 400 600 re 200 200 200 400 re W* n " + GRAY + b"0 0 612 792 re f Q", 1.0),
    "curve over": (GRAY + b"100 396 m 100 700 500 700 500 396 c 500 300 100 300 100 396 c f", 0.5),
    "curve beside": (GRAY + b"100 396 m 100 380 500 380 500 396 c 500 100 100 100 100 396 c f", 1.0),
    "open path": (GRAY + b"100 100 m 500 100 l 500 700 l 100 700 l f", 0.5),
    "stroked": (b"0.5 G 100 100 400 600 re S", 1.0),
}


@pytest.mark.parametrize("turn", [0, 90])
def test_backgrounds_of_pages(spark, turn):
    rows = [(name, pdfs.pdf([content + b"\n" + BAR], page=b"/Rotate %d" % turn)) for name, (content, _) in CASES.items()]
    rel = fs.relations(fs.parse_pdfs(spark.createDataFrame(rows, "doc_id string, content binary")))
    shapes = vector.border_shapes(rel["drawings"], rel["pages"])
    got = {r["doc_id"]: r["background"][0] for r in vector.background_colors(shapes, rel["drawings"], rel["pages"]).collect()}
    assert got == {name: gray for name, (_, gray) in CASES.items()}


def test_winding_against_counting_turns(spark):
    rng = random.Random(18)
    paths = []
    for _ in range(200):
        p = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(rng.randint(0, 9))]
        paths.append([v for a, b in zip(p, [*p[1:], *p[:1]]) for v in (*a, *b)])

    def turns(path):
        import math

        total = 0.0
        for k in range(0, len(path), 4):
            a, b = math.atan2(path[k + 1], path[k]), math.atan2(path[k + 3], path[k + 2])
            total += (b - a + math.pi) % (2 * math.pi) - math.pi
        return round(total / (2 * math.pi))

    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)] + [(999, None)], "id int, path array<double>")
    got = {r["id"]: r["n"] for r in df.select("id", g.winding(F.col("path"), F.lit(0.0), F.lit(0.0)).alias("n")).collect()}
    assert got == {k: turns(p) for k, p in enumerate(paths)} | {999: 0}
