"""All saves of a document from one parse, against opening each slice; object graphs."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.operators import graphs, saves
from docsieve.plans import api, history_queries
from docsieve.settings import Settings
from docsieve.sources import pdf_saves
from docsieve.sources.pdf import Document

from . import pdfs

MANY = Settings(forensics_max_revisions_reported=200, forensics_max_boundary_candidates=200)
COLUMNS = ("openable", "page_count", "object_count", "creation_date", "mod_date", "note")


def _page(k):
    return b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]/Contents 11 0 R/X %d>>" % k


def _random_saves(rng, n):
    """A document that was saved n times: pages come, go and change, trees get inner nodes, dates and catalogs change."""
    raw, kids = pdfs.pdf([b"BT ET"], info=b"<</CreationDate(D:1)/ModDate(D:1)>>"), [10]
    for k in range(n):
        new, objs = 200 + 3 * k, {}
        what = rng.randrange(8)
        if what < 2:
            objs[new] = _page(k)
            kids.append(new)
        elif what == 2 and len(kids) > 1:
            kids.pop(rng.randrange(len(kids)))
        elif what == 3:
            objs[new] = _page(k)
            objs[new + 1] = b"<</Type/Pages/Kids[%d 0 R %d 0 R<</Type/Page>>]/Parent 2 0 R>>" % (new, rng.choice(kids))
            kids.append(new + 1)
        elif what == 4:
            objs[4] = b"<</CreationDate(D:1)/ModDate(D:%d)>>" % k
        elif what == 5:
            objs[rng.choice(kids)] = _page(k)
        elif what == 6:
            objs[new] = b"[%s]" % b" ".join(b"%d 0 R" % x for x in kids)
            objs[2] = b"<</Type/Pages/Kids %d 0 R>>" % new
        else:
            objs[new] = b"<</Producer(x)>>"
        if what < 4:
            objs[2] = b"<</Type/Pages/Count 1/Kids[%s]>>" % b" ".join(b"%d 0 R" % x for x in kids)
        raw = pdfs.save_again(raw, objs)
    return raw


def _want(raw, settings):
    ends = [m + 5 for m in range(len(raw)) if raw.startswith(b"%%EOF", m)]
    return [api.inspect_slice(raw[:e], settings) for e in ends], ends


def test_saves_equal_slices_and_each_file_is_opened_once(spark, monkeypatch):
    rng = random.Random(12)
    files = [_random_saves(rng, n) for n in (0, 1, 5, 12, 25)]
    files.append(files[2].replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt<<>>", 1))
    files.append(b"%PDF-1.4 %%EOF\n" + files[1])
    files.append(files[3].replace(b"startxref", b"startxxxx", 1))  # a save without a table of its own
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, content binary")
    revs, reports, errors = api.discover_revisions(df, MANY)
    got = {}
    for r in revs.orderBy("doc_id", "revision_index").collect():
        got.setdefault(r["doc_id"], []).append({c: r[c] for c in COLUMNS})
    bad = {r["doc_id"] for r in errors.collect()}
    assert 5 in bad or 5 in got
    for k, raw in enumerate(files):
        if k not in bad:
            bounds = api.revisions.boundaries(df.where(F.col("doc_id") == k), MANY).first()["offsets"]
            want = [api.inspect_slice(raw[:e], MANY) for e in bounds]
            assert got[k] == want, k
    assert max(len(x) for x in got.values()) == 26


def test_two_hundred_saves_from_one_parse(monkeypatch):
    raw = _random_saves(random.Random(13), 199)
    ends = [k + 5 for k in range(len(raw)) if raw.startswith(b"%%EOF", k)]
    opened = []
    monkeypatch.setattr(Document, "open", classmethod(lambda cls, raw: opened.append(1)))
    parsed = []
    at = Document._object_at
    monkeypatch.setattr(Document, "_object_at", lambda self, place: parsed.append(place) or at(self, place))
    rows, slices = api.read_saves(raw, ends, MANY)
    assert len(rows["saves"]) == 200 and not slices and not opened and len(parsed) == len(set(parsed))


def test_two_hundred_saves_equal_their_slices(spark):
    raw = _random_saves(random.Random(13), 199)
    revs, _, _ = api.discover_revisions(spark.createDataFrame([(1, raw)], "doc_id long, content binary"), MANY)
    got = [{c: r[c] for c in COLUMNS} for r in revs.orderBy("revision_index").collect()]
    ends = [k + 5 for k in range(len(raw)) if raw.startswith(b"%%EOF", k)]
    assert len(got) == 200 and got == [api.inspect_slice(raw[:e + 1], MANY) for e in ends]


def test_counts_of_saves_from_rows(spark):
    s = spark.createDataFrame([("a", k, 1) for k in range(4)] + [("b", 0, 1)], "doc_id string, save int, root long")
    c = spark.createDataFrame([("a", 0, 1, True), ("a", 0, 2, True), ("a", 1, 2, False), ("a", 3, 2, True), ("a", 3, 5, True), ("a", 3, 9, False)],
                              "doc_id string, save int, object long, alive boolean")
    got = {(r["doc_id"], r["save"]): r["object_count"] for r in saves.object_counts(c, s).collect()}
    assert got == {("a", 0): 2, ("a", 1): 1, ("a", 2): 1, ("a", 3): 3, ("b", 0): 0}
    n = spark.createDataFrame([("a", 0, 1, 0, [2]), ("a", 0, 2, 1, [3, 2]), ("a", 1, 3, 1, [1]), ("a", 3, 2, 0, [3])],
                              "doc_id string, save int, object long, leaves int, kids array<long>")
    got = {(r["doc_id"], r["save"]): r["page_count"] for r in saves.page_counts(n, s).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 2): 2, ("a", 3): 1, ("b", 0): 0}


def test_depths_against_a_plain_search():
    rng = random.Random(14)
    for _ in range(60):
        n = rng.randint(1, 40)
        links = [(rng.randrange(n), rng.randrange(n + 3)) for _ in range(rng.randint(0, 80))]
        roots = [rng.randrange(n) for _ in range(rng.randint(0, 3))]
        want, front = {}, set(roots)
        while front:
            want |= dict.fromkeys(front, max(want.values(), default=-1) + 1)
            front = {b for a, b in links if a in front} - set(want)
        node, depth = graphs.depths(*(np.array(x, np.int64) for x in ([a for a, _ in links], [b for _, b in links], roots)))
        assert dict(zip(node.tolist(), depth.tolist())) == want


def test_graph_reports_limits_cycles_and_unreachable_objects(spark):
    objects = [("ring", k) for k in range(5)] + [("long", k) for k in range(3000)] + [("big", k) for k in range(3001)] + [("none", 1)]
    links = [("ring", None, 0), ("ring", 0, 1), ("ring", 1, 2), ("ring", 2, 0), ("ring", 3, 4), ("ring", 1, 77), ("long", None, 0)] + [("long", k, k + 1) for k in range(2999)] + [("big", None, 0)]
    o = spark.createDataFrame(objects, "doc_id string, object long")
    e = spark.createDataFrame(links, "doc_id string, source long, target long")
    reports, dropped = graphs.report(o, e, Settings(max_pdf_objects=3000, strict=True))
    got = {r["doc_id"]: (r["n_objects"], r["n_reachable"], r["max_depth"], r["error"]) for r in reports.collect()}
    assert got == {"ring": (5, 3, 2, None), "long": (3000, 3000, 2999, graphs.ERROR_DEPTH), "big": (3001, None, None, graphs.ERROR_OBJECTS), "none": (1, 0, None, None)}
    assert sorted(map(tuple, dropped.collect())) == [("none", 1), ("ring", 3), ("ring", 4)]
    assert graphs.report(o, e, Settings(max_pdf_objects=3000))[0].where("doc_id = 'long'").first()["error"] is None


def test_object_graph_of_files(spark):
    raw = pdfs.pdf([b"BT ET", b""], extra=[b"<</A 101 0 R>>", b"<</B 100 0 R>>"])
    df = spark.createDataFrame([("a", raw), ("b", b"no"), ("c", None)], "doc_id string, content binary")
    reports, dropped = api.object_graph(df)
    got = {r["doc_id"]: r for r in reports.collect()}
    assert got["a"]["n_objects"] == 9 and got["a"]["n_reachable"] == 7 and got["b"]["error"] and got["c"]["error"]
    assert sorted(r["object"] for r in dropped.collect()) == [100, 101]
    from docsieve.sources import pdf_writer

    assert Document(pdf_writer.rebuild(Document(raw))).n_objects() == 7


def test_irregular_saves_are_told(spark):
    raw = pdfs.pdf([b""])
    with pytest.raises(pdf_saves.Irregular):
        pdf_saves.read_saves(raw, [20])


def test_many_graphs_are_walked_together_across_batches(spark):
    rng = random.Random(13)
    graphs_of = {(d, e): [(rng.randrange(12) * 10**15, rng.randrange(12) * 10**15) for _ in range(rng.randrange(1, 40))] for d in ("a", "b", None) for e in range(20)}
    rows = [(d, e, a, b) for (d, e), links in graphs_of.items() for a, b in links] + [(d, e, None, links[0][0]) for (d, e), links in graphs_of.items() if e % 4]
    rng.shuffle(rows)
    batch = pa.RecordBatch.from_pylist([{"k": k} for k in [1, 1, 2, 3, 3, 3, 3, None, None, 5]])
    groups = list(graphs.whole_groups((batch.slice(k, 2) for k in range(0, 10, 2)), ["k"]))
    assert [(t.column("k").to_pylist(), g.tolist()) for t, g in groups] == [([1, 1, 2], [0, 0, 1]), ([3] * 4, [0] * 4), ([None] * 2, [0] * 2), ([5], [0])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {}
        for r in graphs.reach(spark.createDataFrame(rows, "d string, e int, source long, target long"), ["d", "e"]).collect():
            got.setdefault((r["d"], r["e"]), {})[r["node"]] = r["depth"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key, links in graphs_of.items():
        front, seen, depth = ({links[0][0]} if key[1] % 4 else set()), {}, 0
        while front:
            seen |= dict.fromkeys(front, depth)
            front, depth = {b for a, b in links if a in front} - set(seen), depth + 1
        if seen:
            want[key] = seen
    assert got == want


@pytest.mark.parametrize("name", ["object_reach", "unreachable_objects"])
def test_graphs_stay_whole_where_links_and_roots_come_from_joins_by_sorting(spark, tmp_path, name):
    rng = random.Random(15)
    rows = [(k, rng.randrange(1500)) for k in range(15_000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    # as in tables too large to be broadcast, whose partitions are merged to different numbers
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in large}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        got = history_queries.QUERIES[name](spark, str(tmp_path))
        cols = sorted(got.columns)
        got = sorted(map(repr, map(tuple, got.select(*cols).collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(map(repr, con.sql(history_queries.ORACLES[name]).select(*cols).fetchall()))
