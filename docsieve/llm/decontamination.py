"""Benchmark decontamination with an FM-index per shard of training documents.

The test phrases are all runs of `window` words of the benchmark items; an item with fewer words is one phrase. Their words are
the alphabet; all other words act as separators. Each shard of training text (about `shard_words` words) gets an FM-index of its
own: suffix order, Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All phrases are searched backward
at once through the ranks of the wavelet matrix; the rows of a phrase that occurs are walked back to a sampled position. The
places are merged into spans of words to remove.

A suffix ends at its first separator and separators differ by position, so the order of suffixes is total and cheap to make.

The benchmark is a stated query set. It is read in blocks of about `block_bytes` of text (an item is in one block). A block is broadcast
as flat arrays, 16 bytes and its letters a word; a Python worker makes of them the phrases as rows of 40 bytes a word. There is one
pass of the documents a block, written before the next one, and a block's broadcast is destroyed after its pass; so blocks are never
held together, neither by the driver nor by executors. Up to `block_bytes`, there is one pass and nothing is written.

Defined results: texts of any length are searched whole; null texts and texts without words have no hits; items without words are never found; items with equal ids are
one item, and a null item id is the string "null"; training rows are handled one by one, null and repeated ids included; other
columns are left out or, in decontaminate(), kept; an empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, materialize, table

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class WaveletMatrix:
    """Ranks of symbols in a sequence of small integers."""

    def __init__(self, x: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            count = np.zeros(len(x) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(x) - int(count[-1]))
            up = bit.astype(bool)
            x = np.concatenate([x[~up], x[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low = np.where(up, zeros + a, low - a)
            high = np.where(up, zeros + b, high - b)
        return high - low


def suffix_order(x: np.ndarray) -> np.ndarray:
    """Order of the suffixes of x, each taken up to its first 0; zeros are ordered by position. x ends with 0."""
    n = len(x)
    bits = max(1, int(x.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)  # no 0 met so far
    for k in range(width):
        now = np.zeros(n, np.int64)
        now[:max(0, n - k)] = x[k:]
        key = (key << bits) | np.where(alive, now, 0)
        alive &= now != 0
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    # suffixes of equal keys that met a 0 are in order already, by position; the others take part in rounds of doubling
    same = np.zeros(n, bool)
    same[1:] = (ordered[1:] == ordered[:-1]) & alive[order[1:]]
    rank = np.empty(n, np.int64)
    while same.any():
        # the rank of a suffix is the index of the first of its group
        group = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        rank[order] = group
        open_ = same.copy()
        open_[:-1] |= same[1:]
        at = np.flatnonzero(open_)
        suffix = order[at]
        second = rank[suffix + width]  # there is a 0 further on, so this is inside
        by = np.lexsort((suffix, second, group[at]))
        order[at] = suffix[by]
        g, s = group[at][by], second[by]
        same = np.zeros(n, bool)
        same[at[1:]] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
        width *= 2
    return order


class FMIndex:
    """Backward search over the words of a shard; symbol 0 separates."""

    def __init__(self, x: np.ndarray, top: int, sample: int = 8):
        order = suffix_order(x)
        self.bwt = x[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, top)
        self.before = np.r_[0, np.cumsum(np.bincount(x, minlength=top + 2))]
        # sampled: every sample-th position, and where a separator goes before, since no walk may cross one
        kept = (order % sample == 0) | (self.bwt == 0)
        self.kept = kept
        self.place = np.cumsum(kept) - 1
        self.position = order[kept]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that begin with each phrase; phrases are right-aligned rows of symbols."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        live = np.flatnonzero(sizes > 0)
        high[sizes == 0] = 0
        for step in range(phrases.shape[1]):
            live = live[(sizes[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        at, live = rows.copy(), np.arange(len(rows))
        while len(live):
            kept = self.kept[at[live]]
            done = live[kept]
            out[done] = self.position[self.place[at[done]]] + steps[done]
            live = live[~kept]
            c = self.bwt[at[live]]
            at[live] = self.before[c] + self.wavelet.rank(c, at[live])
            steps[live] += 1
        return out


class Phrases:
    """The distinct phrases of a block, and the items of each, from the flat arrays of `flat_block`."""

    def __init__(self, flat: tuple):
        vocabulary, codes, start, size, item, self.names = flat
        self.symbol = {w: k + 1 for k, w in enumerate(vocabulary.split(b" "))} if vocabulary else {}
        width = int(size.max(initial=1))
        at = np.arange(width, dtype=np.int32) - (width - size[:, None])  # right-aligned
        rows = np.where(at >= 0, codes[np.minimum(start[:, None] + np.maximum(at, 0), max(0, len(codes) - 1))], 0).astype(np.int32) if len(codes) else np.zeros((0, 1), np.int32)
        self.rows, of = np.unique(rows, axis=0, return_inverse=True)
        self.sizes = (self.rows != 0).sum(axis=1)
        order = np.argsort(of.ravel(), kind="stable")
        self.item = item[order]
        self.first = np.r_[0, np.cumsum(np.bincount(of.ravel(), minlength=len(self.rows)))]

    def items_of(self, phrase: int) -> set[str]:
        return {self.names[k] for k in self.item[self.first[phrase]:self.first[phrase + 1]].tolist()}


def flat_block(items: list[tuple[str, str | None]], window: int) -> tuple:
    """Words of the items joined by spaces, their codes, and start, size and item of each phrase."""
    split = [(name, w) for name, text in items if (w := (text or "").encode().translate(ALNUM).split())]
    words = sorted({w for _, ws in split for w in ws})
    number = {w: k + 1 for k, w in enumerate(words)}
    codes = np.fromiter((number[w] for _, ws in split for w in ws), np.int32)
    names = sorted({n for n, _ in split})
    place = {n: k for k, n in enumerate(names)}
    n = np.array([len(ws) for _, ws in split], np.int32)
    count = np.maximum(1, n - window + 1) if len(n) else n
    begin = np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
    start = (np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())).astype(np.int32) if len(n) else n
    return (b" ".join(words), codes, start, np.repeat(np.minimum(n, window), count).astype(np.int32),
            np.repeat(np.array([place[name] for name, _ in split], np.int32), count), names)


def _shard(words: list[list[bytes]], p: Phrases) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each document: a mask of the words inside any occurrence, and the items that occur."""
    masks = [np.zeros(len(w), bool) for w in words]
    items: list[set[str]] = [set() for _ in words]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.r_[0, np.cumsum(sizes + 1)]  # each document is followed by a separator
    if not len(p.sizes):
        return masks, items
    get = p.symbol.get
    text = np.zeros(first[-1], np.int64)
    for k, w in enumerate(words):
        text[first[k]:first[k] + len(w)] = [get(v, 0) for v in w]
    # separators next to each other are one
    keep = np.r_[True, (text[1:] != 0) | (text[:-1] != 0)] if len(text) else np.zeros(0, bool)
    where = np.flatnonzero(keep)
    x = text[where]
    if not x.any():
        return masks, items
    index = FMIndex(x, len(p.symbol))
    low, high = index.search(p.rows.astype(np.int64), p.sizes)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return masks, items
    n = high[hit] - low[hit]
    rows = np.repeat(low[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    start = where[index.locate(rows)]
    phrase = np.repeat(hit, n)
    mark = np.zeros(first[-1] + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + p.sizes[phrase], -1)
    covered = np.cumsum(mark) > 0
    doc = np.searchsorted(first, start, "right") - 1
    for d, ph in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
        items[d] |= p.items_of(ph)
    for d in np.unique(doc).tolist():
        masks[d] |= covered[first[d]:first[d] + sizes[d]]
    return masks, items


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS = "spans array<struct<start:int,end:int>>, items array<string>"
_here: dict[int, tuple[object, Phrases]] = {}


def _phrases(block) -> Phrases:
    """The phrases of a broadcast block, made once in a Python worker; those of an earlier block are given up."""
    if block.value is not _here.get(0, (None,))[0]:
        _here[0] = (block.value, Phrases(block.value))
    return _here[0][1]


def _pass(docs: DataFrame, block, kind: str, shard_words: int, last: bool) -> DataFrame:
    """docs (id, text, spans, items) with the finds of a block added; after the last one, the columns of find_contamination."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            masks, items = _shard(words, _phrases(block))
            spans, cleaned = [], []
            for m, t, found, (old, names) in zip(masks, texts, items, before):
                for s in old:
                    m[s["start"]:s["end"]] = True
                found.update(names)
                edges = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8))).reshape(-1, 2).tolist() if m.any() else []
                spans.append([{"start": a, "end": b} for a, b in edges])
                cleaned.append(_cut(t, edges) if edges and last else None)
            more = [pa.array(spans, _SPAN), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
            if not last:
                return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(raw), *more], ["id", "text", "spans", "items"])
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array([len(w) for w in words], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), *more, pa.array(cleaned, pa.string())],
                ["id", "n_words", "n_hit", "spans", "items", "clean_text"])

        ids, raw, texts, words, before, held = [], [], [], [], [], 0
        for b in batches:
            lo = 0
            for k, (t, s, i) in enumerate(zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist())):
                texts.append((t.as_py() or "").encode())
                words.append(texts[-1].translate(ALNUM).split())
                before.append((s, i))
                held += len(words[-1]) + 1
                if held >= shard_words or k == b.num_rows - 1:
                    ids.append(b.column(0).slice(lo, k + 1 - lo))
                    raw.append(b.column(1).slice(lo, k + 1 - lo))
                    lo = k + 1
                if held >= shard_words:
                    yield flush()
                    ids, raw, texts, words, before, held = [], [], [], [], [], 0
        if words:
            yield flush()

    return docs.mapInArrow(run, f"id {kind}, n_words long, n_hit long, {_SPANS}, clean_text string" if last else f"id {kind}, text string, {_SPANS}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = 10, shard_words: int = 400_000, block_bytes: int = 4_000_000) -> DataFrame:
    """One row a document: id, n_words, n_hit, spans (word ranges inside occurrences, end exclusive), items (sorted ids), clean_text.

    clean_text is null where nothing was hit; else the text without the words of the spans and what stands between them.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-int(size) // block_bytes))
    if n > 1:  # written by block, so that each is read by itself
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n))).repartition("block").sortWithinPartitions("block"))
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
                        F.array().cast("array<string>").alias("items"))
    for k in range(n):
        rows = (items.where(F.col("block") == k) if n > 1 else items).select("item", "text").collect()  # about block_bytes
        block = spark.sparkContext.broadcast(flat_block([tuple(r) for r in rows], window))
        state = _pass(state, block, kind, shard_words, k == n - 1)
        if k < n - 1:
            state = materialize(state)
            block.destroy()
    return state.withColumnRenamed("id", id_col)


def _cut(raw: bytes, ranges: list[list[int]]) -> str:
    """The text without the words of the ranges and what stands between the words of one range."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    out, end = [], 0
    for a, b in ranges:
        out.append(raw[end:at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, raw[end:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with all occurrences of test phrases cut out of the texts; texts without any stay as they are."""
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("_row"), F.col(text_col).alias("_text"))
    found = find_contamination(packed, benchmark, "_row", "_text", **options)
    return found.select(*(F.coalesce("clean_text", F.col("_row")[c]).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + 9) AS gram
      FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS gram
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT rid, i, g.n, item_id FROM g JOIN p ON g.gram = p.gram),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
