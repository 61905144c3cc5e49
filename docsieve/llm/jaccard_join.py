"""Exact Jaccard join over word n-grams, by a token-group matrix.

Documents with equal sets of shingles are one class; a class stands for all its copies.

1. Order. A pass finds the tokens (shingles) of high frequency; there are at most as many as their least frequency allows. Tokens
   are ordered by the length of their words, long ones first, and by hash; the frequent ones come last.
2. Prefixes. A partner lacks at most e = n - ceil(threshold * n) tokens of a set, so of its first e + k tokens a partner has k, and
   has them among its own first e + k. Prefix tokens of two or more classes are the columns of the token-group matrix; classes
   with too few of them can have no partner.
3. Groups. Classes are put into groups by a min-hash, and large groups are cut into blocks. Links inside a block are found by
   matrix products; blocks of one group are dealt out a second time, so that a large family of near copies grows together.
   Connected components give each class a label.
4. Queries. Tokens whose classes have one label are settled. Of the others, each class first asks one block, which holds the
   largest family that its tokens point to; that settles most. For what is left, the matrix gives the blocks that a class must be
   held against: those with a token of its prefix and with another label. The block's token union bounds the overlap; only
   blocks whose bound is high enough are opened and compared. A pair of classes with equal labels is never compared again. Sets go
   to the blocks in up to `rounds` rounds, so that disk holds the shuffled sets of one round only.

So no pair of documents is left out, no pairs within a family are listed, and what one task holds is bounded by blocks of classes.

Defined results: ids must be integers, others are refused with a TypeError; null texts and texts without words have an empty set and link with nothing; a null id has no component but its
text still links others; repeated rows link as copies; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import scratch
from .common import LOWER, bitmap, components, gram_hashes, in_bitmap, integer_ids, materialize, mix64, shared_dir, table, tidy, word_hashes

_TOP = np.uint64(1 << 63)


@functools.cache
def _give_back() -> None:
    """Have a worker's freed arrays of a megabyte or more go back to the machine at once: it serves further tasks, of later stages too."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # glibc's M_MMAP_THRESHOLD; otherwise it grows with the arrays that were freed
    except (AttributeError, OSError):
        pass  # another C library


def _lean(run: Callable) -> Callable:
    """run, for mapInArrow, without memory that is kept after it."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return go


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct tokens of the k-word shingles of a text; of the whole sequence where it has fewer words.

    A token is the length of the shingle, 255 less the bytes of its words, and 56 bits of its hash: long shingles, which tend to
    be rare, come first.
    """
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    h = word_hashes(w)
    if len(w) < k:
        return (gram_hashes(h, len(h)) ^ np.uint64(0x5851F42D4C957F2D * len(h) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(8)
    size = np.fromiter(map(len, w), np.uint64, len(w))
    total = sum(size[i:len(w) - k + 1 + i] for i in range(k))
    g = np.sort(((np.uint64(255) - np.minimum(total, 255).astype(np.uint64)) << np.uint64(56)) | (gram_hashes(h, k) >> np.uint64(8)))
    return g[np.r_[True, g[1:] != g[:-1]]]


def frequent(sets: list[np.ndarray], least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are in `least` of the sets or more, and in how many; sorted in place, with few arrays beside the tokens."""
    t = np.concatenate([*sets, np.empty(0, np.uint64)])
    t.sort()
    at = np.flatnonzero(t[least - 1:] == t[:len(t) - least + 1]) if len(t) >= least else np.empty(0, np.int64)
    at = at[(at == 0) | (t[at - 1] != t[at])]
    tokens = t[at]
    return tokens, np.searchsorted(t, tokens, "right") - at


def spare(n, percent: int):
    """Tokens of a set of size n that a partner may lack."""
    return n - -(-percent * n // 100)


def least_shared(n, percent: int):
    """Tokens that the prefix of a set of size n is longer than spare(n); partners share as many of the smaller prefix at least."""
    return 1 + spare(n, percent) // 3


def min_hash(tokens: np.ndarray) -> int:
    return int(mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).min().astype(np.int64)) if len(tokens) else 0


def class_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], k: int, most: int = 600_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets of documents, about `most` tokens at a time."""
    ids, sets, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(i)
            sets.append(shingle_set(t.as_py(), k))
            held += len(sets[-1]) + 1
            if held >= most:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _distinct(sets: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    return {(class_of(s), len(s)): s for s in sets if len(s)}


def _least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least size of the intersection of sets of sizes n and m that makes them link."""
    return -(-percent * (n + m) // (100 + percent))


def least_common(n: Column, m_low: Column, m_high: Column, percent: int) -> Column:
    """Least number of prefix tokens that a set of size n shares with a linked set of a size from m_low to m_high.

    The second term falls with the size, but for rounding, by which it may be one smaller below m_high than there.
    """
    slack = lambda n: F.floor(n * (100 - percent) / 100)
    both = lambda m: F.ceil((n + m) * percent / (100 + percent))
    last = slack(m_high) + 1 - (m_high - both(m_high)) - F.when(m_low < m_high, 1).otherwise(0)
    return F.greatest(F.lit(1), F.least(slack(n) + 1 - (n - both(m_low)), last))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for lo in range(0, len(both), width):
        part = both[lo:lo + width]
        out += _rows(left, part) @ _rows(right, part).T
    return out.astype(np.int64)


def _rows(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(part)), np.float32)
    for k, s in enumerate(sets):
        s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
        at = np.searchsorted(part, s)
        out[k, at[part[at] == s]] = 1
    return out


def link_block(classes: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Edges (class, smallest class of its component) among the sets of a block."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    classes, n, sets = classes[order], n[order], [sets[k] for k in order]
    # tokens of one set alone don't count in any intersection
    flat = np.concatenate(sets)
    tokens, count = np.unique(flat, return_counts=True)
    shared = tokens[count > 1]
    if not len(shared):
        return [], []
    cut = [s[_member(shared, s)] for s in sets]
    some = np.array([len(c) for c in cut]) * 100 >= percent * n
    cut, n, classes = [c for c, k in zip(cut, some) if k], n[some], classes[some]
    if len(cut) < 2:
        return [], []
    link = overlaps(cut, cut) >= _least_overlap(n[:, None], n[None, :], percent)
    label = np.arange(len(n))
    while True:
        new = np.where(link, label[None, :], len(n)).min(axis=1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(n)))
    return classes[moved].tolist(), classes[label[moved]].tolist()


def _member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90,
                 block: int = 256, hot: int = 131_072, filter_bits: int = 27, rounds: int = 3, round_rows: int = 4096) -> DataFrame:
    """One row a document: id, n_shingles, class_id (equal sets), component_id (smallest id reachable by links).

    percent: two sets link where 100 * intersection >= percent * union. hot: most tokens that are ordered by frequency. rounds: most
    rounds in which sets go to blocks, one for each `round_rows` sets.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = integer_ids(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    # 1. classes of all documents; tokens found 4 times or more among 4 million, of which there can't be more than a million
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        total = 0

        def often() -> pa.RecordBatch:
            tokens, count = frequent(list(held.values()))
            held.clear()
            m = len(tokens)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.array(tokens.view(np.int64)), pa.array(count), pa.nulls(m, pa.int64()), pa.array(np.zeros(m, bool))], names)

        names = ["doc_id", "key", "n", "low", "doc"]
        for ids, sets in _sets(batches, k):
            cls = [class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(list(map(min_hash, sets)), pa.int64()), pa.array([True] * len(ids))], names)
            for c, s in zip(cls, sets):
                if (c, len(s)) not in held and len(s):
                    held[c, len(s)] = s
                    total += len(s)
            if total >= 4_000_000:
                yield often()
                total = 0
        if total:
            yield often()

    seen = materialize(texts.mapInArrow(_lean(survey), "doc_id long, key long, n long, low long, doc boolean"))
    members = seen.where("doc").select("doc_id", F.col("key").alias("cls"), "n", "low")
    often = (seen.where("not doc").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(hot).toArrow())
    hot_key = often.column("key").to_numpy().view(np.uint64)
    by = np.argsort(hot_key)
    # among the frequent tokens the rarer ones come first
    ranks = sc.broadcast((hot_key[by], (np.uint64(len(hot_key)) - by.astype(np.uint64)) | _TOP))

    # 2. prefixes: the token's place in the order serves as its name. n is sent as n * 2**32, plus the token's position in the set;
    # it is only sent for the tokens of `some`
    def prefixes(batches: Iterator[pa.RecordBatch], some=None) -> Iterator[pa.RecordBatch]:
        often_key, often_rank = ranks.value
        for _, sets in _sets(batches, k):
            tokens, cls, size = [], [], []
            for (c, n), s in _distinct(sets).items():
                first = spare(n, percent) + least_shared(n, percent)
                if len(often_key):
                    at = np.minimum(np.searchsorted(often_key, s), len(often_key) - 1)
                    is_hot = often_key[at] == s
                    if is_hot.any():
                        s = np.r_[s[~is_hot] >> np.uint64(1), np.sort(often_rank[at[is_hot]])][:first]
                    else:
                        s = s[:first] >> np.uint64(1)
                else:
                    s = s[:first] >> np.uint64(1)
                place = (n << 32) + np.arange(len(s))
                if some is not None:
                    kept = in_bitmap(some.value, s)
                    s, place = s[kept], place[kept]
                tokens.append(s)
                cls.append(c)
                size.append(place)
            if tokens:
                m = [len(t) for t in tokens]
                cols = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(cls, np.int64), m)), pa.array(np.concatenate(size))]
                yield pa.RecordBatch.from_arrays(cols, ["token", "cls", "n"]) if some is not None else pa.RecordBatch.from_arrays(cols[:2], ["token", "cls"])

    def filter_of(keys: DataFrame):
        """A broadcast bitmap of the column `key`; at most 2**filter_bits bits, past which it lets more through."""
        n = keys.count()
        return sc.broadcast(bitmap(keys, min(filter_bits, max(16, (16 * n).bit_length()))))

    own = Window.partitionBy("cls")
    slack = lambda n: F.floor(n * (100 - percent) / 100)
    need = lambda n: (1 + F.floor(slack(n) / 3)).cast("long")
    smallest = F.ceil(F.col("n") * percent / 100)  # of a partner
    # tokens of two classes or more, combined before the shuffle, so that one of very many classes is a few rows; then their rows
    several = materialize(texts.mapInArrow(_lean(prefixes), "token long, cls long").groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
                          .where("lo < hi").select("token"))
    few = filter_of(several.select(F.col("token").alias("key")))
    shared = materialize(
        texts.mapInArrow(_lean(lambda batches: prefixes(batches, few)), "token long, cls long, n long").join(several, "token", "left_semi")
        .distinct().selectExpr("token", "cls", "shiftright(n, 32) as n", "n & 4294967295 as place")
        .withColumn("have", F.count("*").over(own)).where(F.col("have") >= need(smallest)).select("token", "cls", "n", "place"))
    involved = shared.select("cls").distinct()
    flags = filter_of(involved.select(F.col("cls").alias("key")))
    classes = materialize(members.where("n > 0").select("cls", "n", "low").distinct().join(involved, "cls", "left_semi"))
    size = materialize(classes.groupBy("low").agg(F.count("*").alias("size")).where("size > 1"))
    flocks = filter_of(size.select(F.col("low").alias("key")))

    several_docs = filter_of(members.where("n > 0").groupBy(F.col("cls").alias("key")).agg(F.count("*").alias("docs")).where("docs > 1").select("key"))

    # 3. the sets of the classes that share prefix tokens; links inside blocks of groups
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, k):
            got = _distinct(sets)
            keys = np.array([c for c, _ in got], np.int64)
            kept = in_bitmap(flags.value, keys.view(np.uint64))
            if kept.any():
                rows = [x for x, y in zip(got.values(), kept) if y]
                low = np.array(list(map(min_hash, rows)), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[kept]), pa.array(low), pa.array(in_bitmap(flocks.value, low.view(np.uint64))),
                     pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(in_bitmap(several_docs.value, keys[kept].view(np.uint64)))],
                    ["cls", "low", "grouped", "tokens", "copied"])

    # one row a class: of those with several documents every task and then every shuffle partition keeps one copy, so no group ever holds
    # copies; the others aren't shuffled for it
    fetched = materialize(texts.mapInArrow(_lean(fetch), "cls long, low long, grouped boolean, tokens binary, copied boolean"))
    uncopied = materialize(fetched.where("copied").dropDuplicates(["cls"]))
    sets = fetched.where("not copied").unionByName(uncopied).drop("copied")
    large = materialize(size.where(F.col("size") > block))  # a group in every `block` classes at most

    def blocks() -> Column:
        return F.ceil(F.coalesce("size", F.lit(1)) / block)

    def salt(seed: int) -> Column:
        return F.pmod(F.xxhash64("cls", F.lit(seed)), blocks()).alias("salt")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        _give_back()
        a, b = link_block(pdf["cls"].to_numpy(np.int64), [np.frombuffer(t, np.uint64) for t in pdf["tokens"]], percent) if len(pdf) > 1 else ([], [])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    flock = sets.where("grouped").select("cls", "low", "tokens")
    once = flock.join(large, "low", "left").select("low", salt(1), "cls", "tokens")
    twice = flock.join(large, "low").select("low", salt(2), "cls", "tokens")
    edges = materialize(once.groupBy("low", "salt").applyInPandas(link, "a long, b long").unionByName(
        twice.groupBy("low", "salt").applyInPandas(link, "a long, b long")))
    # 4. what is left: tokens with several labels
    def labelled(edges: DataFrame) -> DataFrame:
        labels = components(edges)  # node, label
        known = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", "low", F.coalesce("label", "cls").alias("label"))
        weights = labels.groupBy("label").agg(F.count("*").alias("weight"))
        return materialize(known.join(weights, "label", "left").join(large, "low", "left").select(
            "cls", "n", "label", F.struct(F.coalesce("weight", F.lit(1)).alias("weight"), "label").alias("rank"), "low", salt(1), blocks().alias("blocks")))

    def unsettled(known: DataFrame) -> DataFrame:
        # the first spare(n) + 1 tokens are enough here: of them, a pair shares more the nearer its sizes are
        rows = shared.where(F.col("place") <= slack(F.col("n"))).select("token", "cls", "place").join(known, "cls")
        # tables before they are joined by token: with no aggregation in between, a hot token's rows are split among tasks
        mixed = materialize(rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token"))
        return materialize(rows.join(mixed, "token", "left_semi"))

    def answers(asks: DataFrame, known: DataFrame) -> DataFrame:
        """Edges between classes and the blocks (to, block) that they ask."""
        per = asks.groupBy("to", "block").agg(F.ceil(F.count("*") / (2 * block)).alias("parts"))
        asking = asks.join(per, ["to", "block"]).select(
            "to", "block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")).alias("part"), "cls", "label", F.lit(True).alias("asks"))
        opened = known.join(per, (known["low"] == per["to"]) & (known["salt"] == per["block"])).select(
            "to", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "cls", "label", F.lit(False).alias("asks"))
        wanted = materialize(asking.unionByName(opened))

        def ask(pdf: pd.DataFrame) -> pd.DataFrame:
            _give_back()
            q, g = pdf[pdf["asks"]].drop_duplicates("cls"), pdf[~pdf["asks"]].drop_duplicates("cls")
            a, b = _ask(q, g, percent) if len(q) and len(g) else ([], [])
            return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

        def answered(now: DataFrame) -> DataFrame:
            some = filter_of(now.select(F.col("cls").alias("key")).distinct())

            def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array(in_bitmap(some.value, b.column(0).to_numpy().view(np.uint64))))

            picked = sets.select("cls", "tokens").mapInArrow(_lean(pick), "cls long, tokens binary")
            out = materialize(now.join(picked, "cls").groupBy("to", "block", "part").applyInPandas(ask, "a long, b long"))
            some.destroy()
            return out

        n = max(1, min(rounds, wanted.count() // round_rows))
        turn = F.pmod(F.xxhash64("to", "block", "part"), F.lit(n))
        return functools.reduce(DataFrame.unionByName, [answered(wanted.where(turn == k)) for k in range(n)])

    # first each class asks one block only: of the blocks that hold the class of highest rank for one of its tokens, the one with most
    # such tokens. So a family of near copies that is spread over many groups gets one label, and its tokens are settled.
    known = labelled(edges)
    rows = unsettled(known)
    hubs = materialize(rows.groupBy("token").agg(F.max(F.struct("rank", "low", "salt")).alias("hub")))
    best = (rows.join(hubs, "token").where((F.col("label") != F.col("hub.rank.label")) & ((F.col("low") != F.col("hub.low")) | (F.col("salt") != F.col("hub.salt"))))
            .groupBy("cls", "label", "hub.low", "hub.salt").agg(F.count("*").alias("have"))
            .groupBy("cls", "label").agg(F.max(F.struct("have", F.col("low").alias("to"), F.col("salt").alias("block"))).alias("best")))
    edges = edges.unionByName(answers(materialize(best.select("best.to", "best.block", "cls", "label")), known))

    # then the matrix over what is still open gives all blocks that can hold a partner
    known = labelled(edges)
    rows = unsettled(known)
    groups = known.groupBy(F.col("low").alias("to")).agg(F.max("rank").alias("top"), F.max("blocks").alias("parts"))
    matrix = materialize(rows.groupBy("token", F.col("low").alias("to")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("rest")).join(groups, "to"))
    # a class asks the groups that hold a label of higher rank and sizes near its own; but not its own block. The first token that two
    # sets share has all others that they share behind it, in both: what is left of the sets there bounds the overlap.
    other = (F.col("low") != F.col("to")) | (F.col("parts") > 1)
    near = (F.col("n") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("n") * 100)
    enough = F.least(F.col("n") - F.col("place"), "rest") >= F.ceil((F.col("n") + F.greatest("least", smallest)) * percent / (100 + percent))
    asks = (rows.join(matrix, "token").where(other & near & enough & (F.col("rank") < F.col("top")))
            .select("to", "cls", "label", "parts", "low", "salt").distinct()
            .select("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"), "cls", "label", "low", "salt")
            .where((F.col("low") != F.col("to")) | (F.col("salt") != F.col("block"))))
    whole = components(edges.unionByName(answers(materialize(asks.select("to", "block", "cls", "label")), known)))

    # component of each document: the smallest id among the documents of the classes of its component
    first = members.where("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("lo"))
    first = first.join(whole.withColumnRenamed("node", "cls"), "cls", "left")
    low = first.where("label is not null").groupBy("label").agg(F.min("lo").alias("least"))
    first = materialize(first.join(low, "label", "left").select("cls", "n", F.coalesce("least", "lo").alias("component_id")))
    out = members.join(first, ["cls", "n"], "left")
    return out.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _ask(q: pd.DataFrame, g: pd.DataFrame, percent: int) -> tuple[list[int], list[int]]:
    """Edges (query, member) for one member of each other label of the block that links with the query."""
    members = [np.frombuffer(t, np.uint64) for t in g["tokens"]]
    union = np.unique(np.concatenate(members))
    queries = [np.frombuffer(t, np.uint64) for t in q["tokens"]]
    n = np.array([len(s) for s in queries], np.int64)
    # an overlap below percent of the query itself can't be enough, whatever the member
    cut = [s[_member(union, s)] for s in queries]
    good = np.flatnonzero(100 * np.array([len(c) for c in cut]) >= percent * n)
    if not len(good):
        return [], []
    m = np.array([len(s) for s in members], np.int64)
    got = overlaps([cut[k] for k in good], members)
    label, ask_label = g["label"].to_numpy(np.int64), q["label"].to_numpy(np.int64)[good]
    link = (got >= _least_overlap(n[good][:, None], m[None, :], percent)) & (label[None, :] != ask_label[:, None])
    at, to = np.nonzero(link)
    if not len(at):
        return [], []
    one = np.unique(np.stack([at, label[to]], 1), axis=0, return_index=True)[1]
    cls = q["cls"].to_numpy(np.int64)[good]
    return cls[at[one]].tolist(), g["cls"].to_numpy(np.int64)[to[one]].tolist()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents whose component has a smaller id; of rows with equal ids all stay or go.

    The ids that go are written at once, and the join's intermediate tables are deleted before anything is made of docs.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    with scratch(spark):
        joined = jaccard_join(docs, id_col, text_col, **options)
        with tidy(spark):
            joined.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct().write.parquet(path)
    gone = spark.read.schema(docs.select(id_col).schema).parquet(path)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, list_slice(w, i, i + 2) AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.c)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n
"""
