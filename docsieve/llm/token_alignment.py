"""Alignment of two tokenizers' tokens by the bytes they cover.

Both tokenizers cover the same bytes of a text. np.repeat writes each token's index over its bytes, for A and for B; where the pair of
owners changes from one byte to the next a new overlap begins, and where both owners change at once both tokenizers cut there. The
cuts divide the tokens into groups that cover equal bytes; the two tokens that end at a cut are linked.

A is a byte-level vocabulary of the `tokenizers` library, B a sentencepiece model. B puts a space before each text, so A is given
one too. A text whose bytes A or B doesn't give back (B writes spaces as U+2581, so a text with that character isn't given back)
has no tokens, no groups and no links.

How often two ids are linked is counted over the whole corpus: in tasks first, then by Spark. The pairs linked most often, at most
`max_pairs` of them (16 bytes each), are broadcast, and answer for almost all links; the links of all other pairs are joined with
their counts by pair. Each of those is rare, so no key of that join is hot. Where all pairs fit, the join has no rows.

Defined results: a null or empty text has no tokens; strings of special tokens inside texts are plain text; each row is aligned and
counted by itself, repeated rows and null ids included; texts of any length are taken whole; columns other than the id and the text
are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_slices
from .packing import Encoder
from .token_counts import byte_chars

ALIGNED = "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, n_overlaps long"


def token_bytes_a(spec: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    parsed = json.loads(spec)
    back = {c: b for b, c in enumerate(byte_chars())}
    vocab = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for text, k in vocab.items():
        out[k] = bytes(map(back.__getitem__, text))
    return out


def token_bytes_b(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model with byte pieces."""
    return [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
            for k in range(model.get_piece_size())]


def owners(sizes: np.ndarray) -> np.ndarray:
    """The index of the token that owns each byte."""
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first byte of every run of equal owner pairs (a, b): each is one overlap of two tokens."""
    return np.flatnonzero(np.r_[len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][:len(a)])


def cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The last byte before every place where both owners change, the end included."""
    return np.flatnonzero(np.r_[(a[1:] != a[:-1]) & (b[1:] != b[:-1]), len(a) > 0][:len(a)])


class Aligner:
    """Aligns texts of a batch at once."""

    def __init__(self, spec: str, model: bytes, ranks: bytes | None = None, pattern: str | None = None):
        import sentencepiece

        self.a = Encoder(spec, ranks, pattern)
        self.a.tokenizer.encode_special_tokens, self.a.special = True, []  # special strings are plain text, so none has to be kept from the fast way
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = token_bytes_a(spec), token_bytes_b(self.b)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text; none where the bytes of either don't equal the text's, after a space."""
        some = [k for k, t in enumerate(texts) if t]
        none = np.zeros(0, np.int32)
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        got_a = self.a.encode([" " + texts[k] for k in some])
        got_b = self.b.encode([texts[k] for k in some], num_threads=1) if some else []
        for k, raw_a, ids_b in zip(some, got_a, got_b):
            ids_a, want = np.frombuffer(raw_a, self.a.type), b" " + texts[k].encode()
            if b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == want and b"".join(map(self.bytes_b.__getitem__, ids_b)) == want:
                out_a[k], out_b[k] = ids_a.astype(np.int32), np.array(ids_b, np.int32)
        return out_a, out_b

    def align(self, texts: list[str]) -> pa.RecordBatch:
        a, b = self.tokens(texts)
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        flat_a, flat_b = np.concatenate(a), np.concatenate(b)
        # texts lie behind each other and both tokenizers cover each whole, so the end of a text is a cut
        own_a, own_b = owners(self.size_a[flat_a]), owners(self.size_b[flat_b])
        first, last = overlaps(own_a, own_b), cuts(own_a, own_b)
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        groups = np.bincount(text_of_a[own_a[last]], minlength=len(texts))
        per_text = np.bincount(text_of_a[own_a[first]], minlength=len(texts))
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        ends_a = own_a[last] + 1 - np.repeat(start_a, groups)
        ends_b = own_b[last] + 1 - np.repeat(start_b, groups)
        lists = lambda sizes, flat: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [lists(n_a, flat_a), lists(n_b, flat_b), lists(groups, ends_a), lists(groups, ends_b), pa.array(per_text.astype(np.int64))],
            ["a_ids", "b_ids", "a_ends", "b_ends", "n_overlaps"])


@functools.lru_cache(maxsize=1)
def _aligner(*parts) -> Aligner:
    return Aligner(*parts)


def _by_slice(docs: DataFrame, files: tuple[str, str, str | None], pattern: str | None):
    """What mapInArrow runs on (id, text): batches of the id and the columns of ALIGNED. The vocabulary files' contents are broadcast."""
    contents = []
    for path, binary in zip(files, (False, True, True)):
        if path is None:
            contents.append(None)
            continue
        with open(path, "rb") as f:
            contents.append(f.read() if binary else f.read().decode())
    shared = docs.sparkSession.sparkContext.broadcast((*contents, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), 1_000_000):
                got = aligner.align([t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *got.columns], ["id", *got.schema.names])

    return run


def align(docs: DataFrame, a_json: str, b_model: str, a_ranks: str | None = None, pattern: str | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id, a_ids, b_ids, a_ends, b_ends (for each group, how many tokens of A and B come up to its end), n_overlaps.

    The vocabulary files are read on the driver; their contents (4 MB together, a fixed size) are broadcast. a_ranks and pattern:
    A's vocabulary as a rank file with its pattern, by which plain Latin texts are encoded in a third of the time; the ids are the same.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _by_slice(docs, (a_json, b_model, a_ranks), pattern), f"id {kind}, {ALIGNED}")
    return out.withColumnRenamed("id", id_col)


def _ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, start of each row and the end)."""
    return column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]


def _digest(a: list[str], b: list[str], ends_a: list[int], ends_b: list[int]) -> str:
    """SHA-256 of the groups as text; the empty string where there are none."""
    if not ends_a:
        return ""
    out, at_a, at_b = [], 0, 0
    for x, y in zip(ends_a, ends_b):
        out.append(f"{','.join(a[at_a:x])}|{','.join(b[at_b:y])}")
        at_a, at_b = x, y
    return hashlib.sha256(";".join(out).encode()).hexdigest()


def _summary(part: pa.RecordBatch) -> pa.RecordBatch:
    (a, sa), (b, sb), (ea, sg), (eb, _) = (_ragged(part.column(k)) for k in range(1, 5))
    digests, links, times, sizes = [], [], [], []
    for k in range(part.num_rows):
        own_a, own_b = a[sa[k]:sa[k + 1]], b[sb[k]:sb[k + 1]]
        end_a, end_b = ea[sg[k]:sg[k + 1]], eb[sg[k]:sg[k + 1]]
        digests.append(_digest(list(map(str, own_a.tolist())), list(map(str, own_b.tolist())), end_a.tolist(), end_b.tolist()))
        pairs, n = np.unique((own_a[end_a - 1].astype(np.int64) << 32) | own_b[end_b - 1], return_counts=True)
        links.append(pairs)
        times.append(n)
        sizes.append(len(pairs))
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in (links, times)]
    return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.diff(s).astype(np.int64)) for s in (sa, sb, sg)), pa.array(digests), *lists],
                                      ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times"])


def summarize(docs: DataFrame, a_json: str, b_model: str, a_ranks: str | None = None, pattern: str | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """align() in short, in the same pass. One row a document: the id, n_a, n_b, n_groups, groups_sha256, links, times.

    links: the distinct pairs of ids that are linked in the text, a * 2**32 + b, ascending; times: how often each is.
    """
    kind, aligned = docs.schema[id_col].dataType.simpleString(), _by_slice(docs, (a_json, b_model, a_ranks), pattern)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: map(_summary, aligned(batches)),
        f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, times array<long>")
    return out.withColumnRenamed("id", id_col)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: their arrays are long."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def count_pairs(summary: DataFrame, held: int = 1_000_000) -> DataFrame:
    """(pair, count, best) over all links: best where no pair of the same B id has a higher count.

    A task adds up its own counts and passes them on whenever it holds `held` entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([c for _, c in kept]))
            return keys, total

        def out(keys: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:lo + 100_000]), pa.array(total[lo:lo + 100_000])], ["pair", "count"])

        for b in _few(batches):
            kept.append((b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()))
            n += len(kept[-1][0])
            if n >= 2 * held:
                kept = [merged()]
                n = len(kept[0][0])
                if n >= held:
                    yield from out(*kept[0])
                    kept, n = [], 0
        if kept:
            yield from out(*merged())

    counts = summary.select("links", "times").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = materialize(counts)
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", of_b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _frequent(counts: DataFrame, max_pairs: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count of the pairs that are broadcast, at most max_pairs of them, and these pairs, ascending."""
    size = F.floor(F.log2("count")).cast("int")
    least, n = 0, 0
    steps = counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()  # 63 rows at most
    for size, more in steps:
        if n + more > max_pairs:
            least = 1 << size + 1
            break
        n += more
    rows = counts.where(F.col("count") >= least).toArrow()
    pair = rows.column("pair").to_numpy()
    order = np.argsort(pair)
    return least, pair[order], rows.column("count").to_numpy()[order], rows.column("best").to_numpy()[order]


def score_links(summary: DataFrame, id_col: str = "doc_id", max_pairs: int = 2_000_000) -> DataFrame:
    """summary without links and times, but with n_links, n_best and count_sum; summary is read several times, so it should be a written table."""
    counts = materialize(count_pairs(summary))
    least, *known = _frequent(counts, max_pairs)
    shared = summary.sparkSession.sparkContext.broadcast(known)
    keep = [c for c in summary.columns if c not in ("links", "times")]
    kinds = {c: summary.schema[c].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for b in _few(batches):
            (links, start), times = _ragged(b.column(len(keep))), b.column(len(keep) + 1).flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
            there = pair[at] == links if len(pair) else np.zeros(len(links), bool)
            n = np.where(there, times, 0)
            row = np.repeat(np.arange(b.num_rows), np.diff(start))
            total = lambda x: pa.array(_sums(row, x, b.num_rows))
            rest = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, ~there, b.num_rows))].astype(np.int32)), pa.array(links[~there]))
            rest_n = pa.ListArray.from_arrays(rest.offsets, pa.array(times[~there]))
            found = (count[at], best[at]) if len(pair) else (np.zeros(len(links), np.int64), np.zeros(len(links), bool))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], total(times), total(n * found[1]), total(n * found[0]), rest, rest_n],
                [*keep, "n_links", "n_best", "count_sum", "rest", "rest_n"])

    kind = ", ".join(f"{c} {k}" for c, k in kinds.items())
    out = summary.select(*keep, "links", "times").mapInArrow(run, f"{kind}, n_links long, n_best long, count_sum long, rest array<long>, rest_n array<long>")
    if least == 0:  # all pairs were broadcast
        return out.drop("rest", "rest_n")
    # the links of rare pairs: each meets its one count, and a row's sums come back by the row's number
    out = materialize(out.withColumn("_row", F.monotonically_increasing_id()))
    rare = out.select("_row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("_row", F.col("x.rest").alias("pair"), F.col("x.rest_n").alias("n"))
    sums = rare.join(counts.where(F.col("count") < least), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0).cast("long"))).alias(c)
    return out.join(sums, "_row", "left").select(*keep, "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Exact sums of values by row."""
    ends = np.r_[0, np.cumsum(values, dtype=np.int64)]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    return ends[bounds[1:]] - ends[bounds[:-1]]


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    out = score_links(materialize(summarize(table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
