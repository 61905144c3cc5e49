"""Joins of rectangles by cells, first-wins dedupe, medians by histograms."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.functions import geometry as g
from docsieve.operators import audit, raster

BOX = f"doc_id string, page_number int, seq int, rect {g.RECT}, source string"
WORD = f"doc_id string, page_number int, word_seq int, rect {g.RECT}, word string"


def rects(rng, n, sizes, extent):
    out = []
    for _ in range(n):
        x, y = rng.uniform(-extent, extent), rng.uniform(-extent, extent)
        w, h = rng.choice(sizes), rng.choice(sizes)
        out.append((float(round(x)), float(round(y)), float(round(x + w)), float(round(y + h))))
    return out


def meets(a, b):
    return a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]


def test_overlapping_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    special = [(0, 0, 0, 0), (0, 0, 16, 16), (16, 16, 32, 32), (-1e9, -1e9, 1e9, 1e9), (1e8, 5, 2e8, 9), (-16, -16, 0, 0), (5, 5, 5, 90), (9e5, 9e5, 9e5 + 3, 9e5 + 3)]
    left = [tuple(map(float, r)) for r in special] + rects(rng, 150, [0, 1, 15, 16, 17, 200, 5000], 700)
    right = [tuple(map(float, r)) for r in special] + rects(rng, 250, [1, 8, 16, 60, 900], 700)
    page = [rng.randrange(3) for _ in range(400)]
    a = spark.createDataFrame([("d", page[k], k, r, "s") for k, r in enumerate(left)], BOX)
    b = spark.createDataFrame([("d", page[k], k, r, "w") for k, r in enumerate(right)] + [("d", 1, 999, None, "null")], WORD).withColumnRenamed("rect", "word_rect")
    got = [(r["seq"], r["word_seq"]) for r in g.overlapping(a, b, audit.PAGE, "rect", "word_rect").collect()]
    want = [(i, j) for i, r in enumerate(left) for j, w in enumerate(right) if page[i] == page[j] and meets(r, w)]
    assert sorted(got) == want and len(want) > 400
    none = g.overlapping(a.where("false"), b, audit.PAGE, "rect", "word_rect")
    assert none.count() == 0 and none.columns == ["doc_id", "page_number", "seq", "rect", "source", "word_seq", "word_rect", "word"]


def test_a_page_of_many_boxes_and_words_is_under_a_hundredth_of_its_pairs(spark):
    n = 10_000
    at = lambda k, w, h: g.rect(F.col("id") * k % 4000, F.col("id") * (k + 6) % 3000, F.col("id") * k % 4000 + w, F.col("id") * (k + 6) % 3000 + h)
    boxes = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page_number"), F.col("id").alias("seq"), at(37, 50, 20).alias("rect"))
    words = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page_number"), F.col("id").alias("word_seq"), at(53, 30, 10).alias("word_rect"))
    lv = lambda r, up: F.sequence(g.level(F.col(r)), F.lit(up))
    cells = [*audit.PAGE, "cell_level", "cell_x", "cell_y"]
    held = g.in_cells(boxes, "rect", lv("rect", 2)).join(g.in_cells(words, "word_rect", lv("word_rect", 2)), cells).where("cell_level = 2").count()
    pairs = g.overlapping(boxes, words, audit.PAGE, "rect", "word_rect").count()
    assert 0 < pairs <= held < n * n / 100


def test_text_under_boxes_is_in_reading_order_and_whole(spark):
    boxes = spark.createDataFrame([("a", 0, 1, (0.0, 0.0, 100.0, 50.0), "s"), ("a", 0, 2, (300.0, 0.0, 400.0, 50.0), "s"), ("b", 0, 1, (0.0, 0.0, 9.0, 9.0), "s")], BOX)
    words = spark.createDataFrame([("a", 0, k, (10.0 * k, 5.0, 10.0 * k + 9, 15.0), f"w{k}") for k in range(15, -1, -1)], WORD)
    got = {(r["doc_id"], r["seq"]): (r["word_count"], r["char_count"], r["text"]) for r in audit.text_under(boxes, words).collect()}
    text = " ".join(f"w{k}" for k in range(10))
    assert got == {("a", 1): (10, len(text), text), ("a", 2): (0, 0, None), ("b", 1): (0, 0, None)}


def _fold(rows, tolerance):
    kept = []
    for k, r in enumerate(rows):
        if not any(all(abs(p - q) < tolerance for p, q in zip(rows[j], r)) for j in kept):
            kept.append(k)
    return kept


@pytest.mark.parametrize("tolerance", [2.0, 0.5, 0.0])
def test_near_first_equals_the_fold(tolerance):
    rng = random.Random(10)
    for _ in range(30):
        rows = [tuple(rng.uniform(-6, 6) for _ in range(4)) for _ in range(rng.randint(0, 120))] + [(k * 1.5, 0, 1, 1) for k in range(40)] + [(1, 1, 2, 2)] * 3
        assert np.flatnonzero(audit.near_first(np.array(rows, float).reshape(-1, 4), tolerance)).tolist() == _fold(rows, tolerance)


def test_dedupe_of_a_page_with_very_many_boxes(spark):
    rows = spark.range(100_000).select(
        F.lit("d").alias("doc_id"), F.lit(0).alias("page_number"), F.when(F.col("id") < 99_990, "s").otherwise("t").alias("source"), F.col("id").alias("seq"),
        g.rect(F.col("id") % 1000 * 1.5, F.floor(F.col("id") / 1000), F.col("id") % 1000 * 1.5 + 5, F.floor(F.col("id") / 1000) + 5).alias("rect"))
    got = audit.dedupe(rows).where("source = 's'")
    chain = _fold([(k * 1.5, y, k * 1.5 + 5, y + 5) for y in range(4) for k in range(100)], 2.0)
    kept = {r["seq"] for r in got.where("seq % 1000 < 90 and seq < 4000").collect()}
    assert kept == {k // 100 * 1000 + k % 100 for k in chain if k % 100 < 90}
    assert audit.dedupe(rows.limit(0)).count() == 0


def test_medians_by_histograms_equal_percentiles(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.choice([None, *range(256)])) for _ in range(2000)] + [("c", 0, None), ("d", 1, 7), ("e", 0, 1), ("e", 0, 4)]
    df = spark.createDataFrame(rows, "k string, c int, v int")
    want = df.groupBy("k", "c").agg(F.floor(F.percentile("v", F.lit(0.5))).cast("long").alias("median"))
    assert sorted(map(str, raster.channel_median(df, ["k", "c"], "v").collect())) == sorted(map(str, want.collect()))


def test_crowded_pages_beside_others_have_the_text_of_all_their_boxes(spark):
    rng = random.Random(12)
    left = {"a": rects(rng, audit.FEW + 9, [0, 16, 200, 900], 500), "b": rects(rng, audit.FEW, [16, 200], 500), "c": rects(rng, 2, [900], 500)}
    right = {d: rects(rng, 120, [1, 8, 60], 500) for d in "abd"}
    boxes = spark.createDataFrame([(d, 0, k, r, "s") for d, rs in left.items() for k, r in enumerate(rs)], BOX)
    words = spark.createDataFrame([(d, 0, k, r, f"w{k}") for d, rs in right.items() for k, r in enumerate(rs)], WORD)
    got = {(r["doc_id"], r["seq"]): (r["word_count"], r["char_count"], r["text"]) for r in audit.text_under(boxes, words).collect()}
    want = {(d, k): [f"w{j}" for j, w in enumerate(right.get(d, [])) if meets(r, w)] for d, rs in left.items() for k, r in enumerate(rs)}
    assert got == {k: (len(v), len(" ".join(v)), " ".join(v) or None) for k, v in want.items()} and max(map(len, want.values())) > 5


def _shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
@pytest.mark.parametrize("name", ["text_under_box", "audit_report"])
def test_less_is_shuffled_than_the_texts_hold(spark, name):
    from docsieve.plans.queries import QUERIES

    docs, before = "/root/testdata/sf0.01", _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, docs).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    time.sleep(1)
    text = spark.read.parquet(f"{docs}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert _shuffled(spark) - before < 2 * text


def test_relations_in_small_files_are_not_broadcast_whole(spark, tmp_path):
    """20,000 pages take a few kB as a file, so by their estimated size they would go to every executor whole, and ten million too."""
    n, here = 20_000, spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_number"))
    box = g.rect(*map(F.lit, (70, 690, 270, 720)))
    black = F.array(*[F.lit(0.0)] * 3)
    made = {"pages": here.withColumn("page_rect", g.rect(*map(F.lit, (0, 0, 612, 792)))),
            "drawings": here.select("*", F.lit(0).alias("seq"), box.alias("rect"), black.alias("fill"), F.lit(1.0).alias("fill_opacity")),
            "words": here.select("*", F.lit(0).alias("word_seq"), box.alias("rect"), F.lit("word").alias("word"))}
    for name, rows in made.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    pages, drawings, words = (spark.read.parquet(f"{tmp_path}/{name}") for name in made)
    found = audit.findings(audit.vector_candidates(drawings, pages), words)
    for rows in (found, audit.report(found, pages)):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert found.where("risk_level = 'critical' and underlying_word_count = 1").count() == n
