"""Object graphs of documents: what can be reached from the roots, how deep, and what a rebuild drops.

A graph is rows (keys, source, target); rows with a null source name the roots. The rows of one graph meet in one task, so callers
refuse graphs past a limit before (`limited`), which needs counts alone, added up before they are shuffled. One shuffle serves any
depth: lists of thousands of links, which documents have, would be thousands of rounds otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings

#: Errors.
ERROR_OBJECTS = "Document object graph exceeds safe processing limits."
ERROR_DEPTH = "Document structure exceeds maximum nesting depth."


def depths(source: np.ndarray, target: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least number of links from a root) of all nodes that can be reached; cycles end where a node was seen."""
    names, code = np.unique(np.concatenate([source, target, roots]), return_inverse=True)
    a, b, front = np.split(code, [len(source), len(source) + len(target)])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(len(names) + 1))
    depth = np.full(len(names), -1, np.int64)
    front, level = np.unique(front), 0
    while len(front):
        depth[front] = level
        size = start[front + 1] - start[front]
        at = np.repeat(start[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        front = np.unique(b[at])
        front, level = front[depth[front] < 0], level + 1
    seen = depth >= 0
    return names[seen], depth[seen]


def _same(a: pa.Array) -> np.ndarray:
    """Which values equal the one before; nulls equal each other."""
    code = a.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return code[1:] == code[:-1]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of several groups, the number of each row's group), from rows sorted by keys: all groups that end in a batch, with what they had before."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[tuple[pa.Table, np.ndarray]]:
        if rows := sum(b.num_rows for b in held):
            t = pa.Table.from_batches(held).combine_chunks()
            same = np.logical_and.reduce([_same(t.column(k).combine_chunks()) for k in keys])
            yield t, np.concatenate([np.zeros(1, np.int64), np.cumsum(~same)]) if rows > 1 else np.zeros(1, np.int64)

    for b in batches:
        if not b.num_rows:
            continue
        starts = np.flatnonzero(~np.logical_and.reduce([_same(b.column(k)) for k in keys])) + 1
        at = int(starts[-1]) if len(starts) else 0
        if at or held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            held.append(b.slice(0, at))
            yield from out()
            held = []
        held.append(b.slice(at))
    yield from out()


def reach(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, depth) of all nodes that can be reached from the roots of their graph. links: keys, source, target (longs).

    The graphs of a batch of rows are walked together, since most are small. Rows are dealt by a hash of the keys, never by the keys: where links
    come from a union of joins by key, Spark takes that for dealt already and leaves the shuffle out, but then merges the small partitions of
    each part of the union by itself, so the roots and the links of a graph would be in several tasks.
    """
    rows = links.select(*keys, "source", "target").where("target is not null")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", node long, depth long"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, graph in whole_groups(batches, keys):
            source, target = t.column("source").combine_chunks(), t.column("target").to_numpy()
            root = source.is_null().to_numpy(zero_copy_only=False)
            names, code = np.unique(np.concatenate([source.fill_null(0).to_numpy(zero_copy_only=False), target]), return_inverse=True)
            a, b = (graph * len(names) + c for c in np.split(code, 2))
            node, depth = depths(a[~root], b[~root], b[root])
            at = pa.array(np.searchsorted(graph, node // len(names)))
            out = {**{k: t.column(k).take(at) for k in keys}, "node": names[node % len(names)], "depth": depth}
            yield from pa.table(out).to_batches(max_chunksize=10_000)

    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInArrow(walk, schema)


def limited(objects: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, n_objects, error): documents and whether they have too many objects. objects: a row an object."""
    n = F.count("*")
    return objects.groupBy("doc_id").agg(n.alias("n_objects"), F.when(n > settings.max_pdf_objects, ERROR_OBJECTS).alias("error"))


def report(objects: DataFrame, links: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(reports, unreachable objects).

    objects: doc_id, object; links: doc_id, source, target, null sources for roots. A report has n_objects, n_reachable, max_depth and
    error; with settings.strict, also a graph that is deeper than max_pdf_nest_depth has an error. What a rebuild drops are the
    unreachable objects (doc_id, object) of documents without an error.
    """
    size = limited(objects, settings)
    small = size.where("error is null").select("doc_id")
    seen = reach(links.join(small, "doc_id", "left_semi"), ["doc_id"])
    mine = objects.select("doc_id", F.col("object").alias("node"))
    known = seen.join(mine, ["doc_id", "node"], "left_semi")  # links may point to objects that aren't there
    per = known.groupBy("doc_id").agg(F.count("*").alias("n_reachable"), F.max("depth").alias("max_depth"))
    deep = F.when(F.col("max_depth") > settings.max_pdf_nest_depth, ERROR_DEPTH) if settings.strict else F.lit(None)
    reports = size.join(per, "doc_id", "left").select(
        "doc_id", "n_objects", F.when(F.col("error").isNull(), F.coalesce("n_reachable", F.lit(0).cast("long"))).alias("n_reachable"), "max_depth",
        F.coalesce("error", deep.cast("string")).alias("error"))
    dropped = mine.join(small, "doc_id", "left_semi").join(seen.select("doc_id", "node"), ["doc_id", "node"], "left_anti")
    return reports, dropped.withColumnRenamed("node", "object")
