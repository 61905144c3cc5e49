"""Removal of passages that an earlier document has too, word by word exact.

A window is `window` consecutive words. A window is removed from a document if the same words start somewhere in a document with
a smaller id; a word goes if any removed window covers it.

1. Confirm. Every window has an anchor: the phrase of window/2 words in it with the smallest hash (the leftmost of equals), so
   equal windows have equal anchors, and one anchor stands for up to 26 windows. Their joint span is the anchor's context.
   A first pass sums up, for each anchor and context, the smallest and the largest document. A second pass emits, for the anchors
   that recur, the hash of the context; where an anchor has several contexts, the hashes of its windows too. The smallest document
   of each hash is found by aggregation, so a passage in a third of all documents is combined before the shuffle.
2. Passages. The smallest documents of what recurs give the words of their recurring passages, in pieces of at most `piece`
   windows.
3. Automata. Documents that have a recurring passage of a smaller document are dealt into shards. Each shard gets the passages that
   its documents ask for and compiles their anchors into an Aho-Corasick automaton over exact codes of words. The documents stream
   through it; where a phrase is found, the windows around it are held against the passages word by word, and only equal words
   are removed. Hashes choose what is compared; they decide nothing. All other documents are read as they stand.

A shard holds about `shard_bytes` of text; one with more than four times that (many rows of one id and text) is split. The filters
broadcast between the passes are bitmaps of at most 2**filter_bits bits; past that they let more through, and results stay the same.

Defined results: ids must be integers, others are refused with a TypeError; null and empty texts have no words, nothing removed and
the hash of the empty string; texts of any length are taken whole. Rows with a null id are compared with nothing. Rows with equal
ids don't remove from each other. Other columns are left out. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, gram_hashes, in_bitmap, integer_ids, materialize, mix64, table, word_hashes

_K = np.uint64(0x9E3779B97F4A7C15)
_DIGITS = 63


class Windows:
    """Windows, anchors and contexts of many documents in flat arrays."""

    def __init__(self, hashes: list[np.ndarray], window: int):
        half = window // 2
        span = window - half + 1  # phrases of a window
        sizes = np.array([len(h) for h in hashes], np.int64)
        self.offset = np.r_[0, np.cumsum(sizes)]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.window, self.half = window, half
        count = np.maximum(sizes - window + 1, 0)
        self.doc = np.repeat(np.arange(len(sizes)), count)
        first = np.r_[0, np.cumsum(count)][:-1]
        #: starts of the windows, in the flat array
        self.start = np.arange(len(self.doc)) - np.repeat(first - self.offset[:-1], count)
        if not len(self.start):
            self.hash = self.anchor = self.context = np.empty(0, np.uint64)
            self.at = self.lo = self.hi = self.owner = np.empty(0, np.int64)
            return
        grams = gram_hashes(h, half)
        self.hash = gram_hashes(h, window)[self.start]
        # leftmost smallest phrase of each window, by doubling
        best, width = np.arange(len(grams)), 1
        pick = lambda a, b: np.where(grams[b] < grams[a], b, a)
        while width * 2 <= span:
            best = pick(best[:-width], best[width:])
            width *= 2
        low = pick(best[self.start], best[self.start + span - width])
        new = np.r_[True, (low[1:] != low[:-1]) | (self.doc[1:] != self.doc[:-1])]
        #: contexts: the windows lo..hi (inclusive) of document `owner` have the phrase at `at`
        self.lo = np.flatnonzero(new)
        self.hi = np.r_[self.lo[1:], len(low)] - 1
        self.at = low[self.lo]
        self.owner = self.doc[self.lo]
        self.anchor = grams[self.at]
        size = (self.hi - self.lo).astype(np.uint64)
        lead = (self.at - self.start[self.lo]).astype(np.uint64)
        self.context = mix64(mix64(self.hash[self.lo] * _K + self.hash[self.hi]) + size * np.uint64(64) + lead + np.uint64(1))


def _batches(batches: Iterator[pa.RecordBatch], least: int, most: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]]]]:
    """Ids, shards (where there are any) and words of documents with at least `least` words, about `most` words at a time."""
    ids, shards, held, total = [], [], [], 0
    for b in batches:
        shard = b.column(2).to_pylist() if b.num_columns > 2 else [0] * b.num_rows
        for i, t, s in zip(b.column(0).to_pylist(), b.column(1), shard):
            w = t.as_py()
            if i is None or w is None:
                continue
            w = w.encode().split()
            if len(w) >= least:
                ids.append(i)
                shards.append(s)
                held.append(w)
                total += len(w)
            if total >= most:
                yield np.array(ids, np.int64), np.array(shards, np.int32), held
                ids, shards, held, total = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(shards, np.int32), held


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Indices of the first row of each distinct key."""
    k = keys[0]
    for x in keys[1:]:
        k = mix64(k * _K + x.astype(np.uint64))
    return np.unique(k, return_index=True)[1]


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo[k] .. lo[k] + n[k] - 1 for all k, one after another."""
    return np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true values, end exclusive."""
    return np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).reshape(-1, 2)


def _same(x: np.ndarray) -> list[np.ndarray]:
    """The indices of the runs of equal values."""
    return np.split(np.arange(len(x)), np.flatnonzero(x[1:] != x[:-1]) + 1)


def _piece(x: Windows, first: int, last: int, doc: np.ndarray, words: list[list[bytes]], keyed: np.ndarray, keys: np.ndarray) -> tuple[int, int, list[int], str]:
    """A passage of the windows first..last of one document: its number, the document, the keys of its windows and contexts, its words."""
    d = int(x.doc[first])
    # a context is named where it begins, and all pieces that have a window of it must bear its name
    own = keys[np.searchsorted(keyed, first - x.window):np.searchsorted(keyed, last, "right")]
    begin, end = int(x.start[first] - x.offset[d]), int(x.start[last] - x.offset[d]) + x.window
    pid = mix64(x.hash[[first]] * _K + x.hash[[last]] + np.uint64(end - begin)) ^ mix64(doc[[d]].view(np.uint64))
    return int(pid.view(np.int64)[0]), int(doc[d]), own.tolist(), b" ".join(words[d][begin:end]).decode()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                    shard_bytes: int = 8_000_000, filter_bits: int = 27, piece: int = 1000) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_text (kept words joined by a space), removed (word ranges, end exclusive)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = integer_ids(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    # 1. anchors and contexts with their smallest and largest document
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, words in _batches(batches, window):
            x = Windows([word_hashes(w) for w in words], window)
            one = _firsts(x.anchor, x.context, x.owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.anchor[one].view(np.int64)), pa.array(x.context[one].view(np.int64)), pa.array(ids[x.owner[one]])],
                ["anchor", "context", "doc_id"])

    pairs = (docs.mapInArrow(confirm, "anchor long, context long, doc_id long").groupBy("anchor", "context")
             .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
    anchors = materialize(pairs.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
                          .where("lo < hi").select("anchor", (F.col("n") > 1).alias("several")))

    def filter_of(keys: DataFrame):
        return sc.broadcast(bitmap(keys, min(filter_bits, max(16, (16 * keys.count()).bit_length()))))

    recurs = filter_of(anchors.select(F.col("anchor").alias("key")))
    several = filter_of(anchors.where("several").select(F.col("anchor").alias("key")))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(-(-int(size) // shard_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, shard, words in _batches(batches, window):
            x = Windows([word_hashes(w) for w in words], window)
            hit = np.flatnonzero(in_bitmap(recurs.value, x.anchor))
            if not len(hit):
                continue
            hit = hit[np.argsort(doc[x.owner[hit]], kind="stable")]
            one = hit[_firsts(x.context[hit], x.owner[hit])]
            # a document that isn't the smallest of its context loses all windows of the context, so only the smallest one's count
            more = hit[_firsts(x.context[hit])]
            more = more[in_bitmap(several.value, x.anchor[more])]
            at = _spread(x.lo[more], x.hi[more] - x.lo[more] + 1)
            owner = np.r_[x.owner[one], x.doc[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[x.context[one], x.hash[at]].view(np.int64)), pa.array(doc[owner]), pa.array(shard[owner])], ["key", "doc_id", "shard"])

    rows = materialize(dealt.mapInArrow(units, "key long, doc_id long, shard int"))
    # a table before the join, so that the rows of a passage which very many documents have can be split among tasks
    least = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", "lo"))
    asks = materialize(rows.join(least, "key").where("doc_id > lo"))
    asked = materialize(asks.groupBy("shard", "key").agg(F.min("lo").alias("lo")))
    askers = filter_of(asks.select(F.col("doc_id").alias("key")).distinct())

    # 2. the passages of the smallest documents
    wanted = materialize(asked.select("key", "lo").distinct())
    givers = filter_of(wanted.select(F.col("lo").alias("key")).distinct())
    given = filter_of(wanted.select(F.col("key").bitwiseXOR(F.col("lo")).alias("key")))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(in_bitmap(givers.value, b.column(0).fill_null(0).to_numpy().view(np.uint64)))) for b in batches)
        for doc, _, words in _batches(some, window):
            x = Windows([word_hashes(w) for w in words], window)
            own = doc.view(np.uint64)
            c = np.flatnonzero(in_bitmap(recurs.value, x.anchor) & in_bitmap(given.value, x.context ^ own[x.owner]))
            at = _spread(x.lo, x.hi - x.lo + 1)[np.repeat(in_bitmap(several.value, x.anchor), x.hi - x.lo + 1)]
            at = at[in_bitmap(given.value, x.hash[at] ^ own[x.doc[at]])]
            inside = _spread(x.lo[c], x.hi[c] - x.lo[c] + 1)
            keyed = np.r_[x.lo[c], at]
            keys = np.r_[x.context[c], x.hash[at]].view(np.int64)
            order = np.argsort(keyed, kind="stable")
            keyed, keys = keyed[order], keys[order]
            mask = np.zeros(len(x.start), bool)
            mask[inside] = mask[at] = True
            pieces = [_piece(x, lo + int(mine[0]), lo + int(mine[-1]), doc, words, keyed, keys)
                      for a, b in _runs(mask).tolist() for lo in range(a, b, piece) for mine in _same(x.doc[lo:min(b, lo + piece)])]
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*pieces), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()))],
                                                 ["pid", "doc_id", "keys", "words"])

    texts = materialize(dealt.mapInArrow(passages, "pid long, doc_id long, keys array<long>, words string"))
    named = texts.select("pid", F.col("doc_id").alias("lo"), F.explode("keys").alias("key")).distinct()
    side = (asked.join(named, ["key", "lo"]).select("shard", "pid").distinct()
            .join(texts.select("pid", F.col("doc_id").alias("lo"), "words").dropDuplicates(["pid"]), "pid").select("shard", "lo", "words"))

    # 3. each shard's automaton over the shard's documents; documents that ask for nothing are finished where they are
    large = materialize(dealt.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("text")) / (4 * shard_bytes)).alias("splits")).where("splits > 1"))
    parts = F.coalesce("splits", F.lit(1))

    def asking(b: pa.RecordBatch) -> np.ndarray:
        return in_bitmap(askers.value, b.column(0).fill_null(0).to_numpy().view(np.uint64)) & ~b.column(0).is_null().to_numpy(False)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:  # numbered, so that a split doesn't depend on what follows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows))], ["doc_id", "text", "shard", "row"]).filter(pa.array(asking(b)))
            n += b.num_rows

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            b = b.filter(pa.array(~asking(b)))
            words = [(t.as_py() or "").encode().split() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(np.zeros(len(words), np.int64)),
                 pa.array([b" ".join(w).decode() for w in words], pa.string()), pa.array([[]] * len(words), ranges)],
                ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    def strip(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_strip(texts, known, window), columns=["doc_id", "n_words", "n_removed", "kept_text", "removed"])
        return out.astype({"doc_id": "int64", "n_words": "int64", "n_removed": "int64"})

    out = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"
    spread = (dealt.mapInArrow(pick, "doc_id long, text string, shard int, row long").join(large, "shard", "left")
              .select("shard", F.pmod("row", parts).alias("part"), "doc_id", "text"))
    copies = side.join(large, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "lo", "words")
    stripped = spread.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(strip, out)
    return docs.mapInArrow(keep, out).unionByName(stripped).withColumnRenamed("doc_id", id_col)


class Passages:
    """The automaton of the anchors of a shard's passages, and the windows of the passages by hash."""

    def __init__(self, passages: list[list[bytes]], owners: np.ndarray, window: int):
        import ahocorasick

        self.window = window
        self.code = {w: k + 1 for k, w in enumerate(sorted({w for p in passages for w in p}))}
        self.width = 1  # letters a word
        while _DIGITS ** self.width <= len(self.code):
            self.width += 1
        self.codes = self.encode([w for p in passages for w in p])
        x = Windows([word_hashes(p) for p in passages], window)
        self.automaton = ahocorasick.Automaton()
        letters = self.letters(self.codes)
        for at in np.unique(x.at).tolist():
            self.automaton.add_word(letters[self.width * at:self.width * (at + x.half)], True)
        if len(self.automaton):
            self.automaton.make_automaton()
        # windows of equal hashes in layers: a layer has one row a hash, the one of the smallest owner; other words with the hash follow
        self.layers = []
        owner = owners[x.doc]
        rows = np.lexsort((owner, x.hash))
        while len(rows):
            h = x.hash[rows]
            new = np.r_[True, h[1:] != h[:-1]]
            first = rows[new][np.cumsum(new) - 1]
            self.layers.append((h[new], x.start[rows[new]], owner[rows[new]]))
            rows = rows[~self._equal(self.codes, x.start[rows], x.start[first])]

    def encode(self, words: list[bytes]) -> np.ndarray:
        """Exact codes of words; 0 for those of no passage."""
        get = self.code.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def letters(self, codes: np.ndarray) -> str:
        """A word is its code's digits, each from an alphabet of its own, so that a phrase can only be found where a word begins.

        An automaton looks through the branches of a node one by one; small alphabets keep them few.
        """
        out = np.empty((len(codes), self.width), np.uint8)
        for k in range(self.width):
            out[:, k] = codes // _DIGITS ** k % _DIGITS + (1 + _DIGITS * k)
        return out.tobytes().decode("latin-1")

    def _equal(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at a in codes have the words of the windows at b of the passages."""
        span = np.arange(self.window)
        out = np.empty(len(a), bool)
        for lo in range(0, len(a), 50_000):
            part = slice(lo, lo + 50_000)
            out[part] = (codes[a[part, None] + span] == self.codes[b[part, None] + span]).all(axis=1)
        return out

    def found(self, codes: np.ndarray, half: int) -> np.ndarray:
        """Where the automaton finds a phrase: the places of its first words."""
        if not len(self.automaton):
            return np.empty(0, np.int64)
        ends = np.fromiter((e for e, _ in self.automaton.iter(self.letters(codes))), np.int64)
        return (ends + 1) // self.width - half

    def earlier(self, codes: np.ndarray, start: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the words of each window are those of a window in a passage of a document with a smaller id."""
        out = np.zeros(len(start), bool)
        for key, place, owner in self.layers:
            at = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
            some = np.flatnonzero((key[at] == hashes) & (owner[at] < ids) & ~out)
            out[some] = self._equal(codes, start[some], place[at[some]])
        return out


def _strip(texts: pd.DataFrame, known: pd.DataFrame, window: int) -> Iterator[tuple]:
    shard = Passages([p.encode().split() for p in known["words"]], known["lo"].to_numpy(np.int64), window)
    ids, raw = texts["doc_id"].to_numpy(np.int64), texts["text"].tolist()
    del texts
    lo = 0
    while lo < len(raw):
        hi, held = lo, 0
        while hi < len(raw) and held < 2_000_000:
            held += len(raw[hi] or "")
            hi += 1
        words = [(t or "").encode().split() for t in raw[lo:hi]]
        # documents in which the automaton finds a phrase, and where
        some, coded, places, base = [], [], [], 0
        for k, w in enumerate(words):
            codes = shard.encode(w)
            if len(at := shard.found(codes, window // 2)):
                some.append(k)
                coded.append(codes)
                places.append(at + base)
                base += len(w)
        gone: dict[int, np.ndarray] = {}
        if some:
            x = Windows([word_hashes(words[k]) for k in some], window)
            doc = ids[lo + np.array(some)]
            found = np.zeros(base, bool)
            found[np.concatenate(places)] = True
            c = np.flatnonzero(found[x.at])
            at = _spread(x.lo[c], x.hi[c] - x.lo[c] + 1)
            at = at[shard.earlier(np.concatenate(coded), x.start[at], x.hash[at], doc[x.doc[at]])]
            mark = np.zeros(base + 1, np.int64)
            np.add.at(mark, x.start[at], 1)
            np.add.at(mark, x.start[at] + window, -1)
            covered = np.cumsum(mark[:-1]) > 0
            gone = {k: covered[x.offset[j]:x.offset[j + 1]] for j, k in enumerate(some)}
        for k, w in enumerate(words):
            g = gone.get(k)
            ranges = []
            if g is not None and g.any():
                ranges = [{"start": a, "end": b} for a, b in _runs(g).tolist()]
                w = [v for v, r in zip(w, g.tolist()) if not r]
            yield int(ids[lo + k]), len(words[k]), len(words[k]) - len(w), b" ".join(w).decode(), ranges
        lo = hi


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, rid, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS gram
      FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT gram, min(doc_id) AS lo FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
r AS (SELECT rid, list(i ORDER BY i) AS s FROM g JOIN f USING (gram) WHERE doc_id > lo GROUP BY rid),
c AS (SELECT DISTINCT rid, unnest(list_concat([0], range(1, 50))) + i AS p FROM (SELECT rid, unnest(s) AS i FROM r)),
x AS (SELECT rid, list(p) AS p, count(*) AS n FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE k END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (rid) LEFT JOIN (
  SELECT rid, list(v ORDER BY q) AS k FROM (SELECT rid, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS q FROM d) u
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rid = u.rid AND c.p = u.q) GROUP BY rid) kept USING (rid)
"""
