"""Packing of token streams into sequences of fixed length, with a controlled mixture of sources.

Every source is a queue of its documents' tokens. The queues are served by deficit round-robin: each sequence gives each queue a
credit of its share, the whole part of the credit is served, the fraction is carried to the next sequence, and places that
are left go to the queues with the largest credit. Documents are cut where a credit ends. Target shares can be given (`targets`);
without, each source has its share of all tokens. A source that runs dry is left out from the next epoch on, and the others keep
their proportions; sources without a target come last. Each token is packed once whatever the targets.

The work is dealt into epochs of about `epoch` sequences. Of a queue with T tokens, epoch e of n holds the tokens from
floor(T * e / n) to floor(T * (e + 1) / n), so a queue's deficit is carried across epochs in closed form, and any task can
work out the cuts of an epoch from the totals of the queues alone. Tokens are counted and kept in one pass, which writes a table;
token counts by partition and queue are shuffled, the ids only where those counts are too many to broadcast (`broadcast_rows`).
Each epoch may end in one short sequence.

Queues are sources. With more than `max_queues` sources their totals stay in a table: documents are cut at the bounds of epochs and
shuffled by epoch, and a task takes the counts of an epoch from its rows. The pieces are the same, and the driver holds no queues.

Defined results: a null or empty text is the end token alone; a null source is a queue of its own; null and repeated ids are
packed row by row; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Up to here the character classes of the pre-tokenizer are the same in every Unicode version and regex library.
_FAR = re.compile("[^\x00-\u036f]")


class Encoder:
    """Token ids of texts as the `tokenizers` library gives them for a vocabulary file.

    With the same vocabulary as a rank file, texts of plain Latin characters without special strings are encoded by tiktoken,
    which takes a third of the time for the same ids; all others by `tokenizers` itself.
    """

    def __init__(self, spec: str, ranks: bytes | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.fast = None
        if ranks is not None:
            import tiktoken

            merges = {base64.b64decode(x): int(n) for x, n in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = []
        slow = []
        for t in texts:
            if self.fast is None or any(x in t for x in self.special) or not t.isascii() and _FAR.search(t):
                slow.append(len(out))
                out.append(b"")
            else:
                out.append(np.array(self.fast.encode_ordinary(t), self.type).tobytes())
        for k, e in zip(slow, self.tokenizer.encode_batch([texts[k] for k in slow], add_special_tokens=False) if slow else ()):
            out[k] = np.array(e.ids, self.type).tobytes()
        return out


class Epochs:
    """The cuts of every epoch, from the totals of the queues and the target shares.

    With targets, the queues are served in phases: a phase ends where a queue runs dry, and the others go on by their targets among
    themselves. An epoch lies in one phase. Queues without a target come last, by their totals. Without any targets there is one
    phase, in which each queue has its share of all tokens, and all run dry together.
    """

    def __init__(self, totals: list[int], length: int, epoch: int, targets: list[float] | None = None):
        self.totals, self.length = totals, length
        self.stride = 4 * epoch  # sequence numbers of an epoch
        self.most = max(4, 64_000_000 // (16 * (epoch + 2) * max(1, len(totals))))  # epochs kept, 64 MB of cuts
        #: first epoch of each phase, and the tokens of each queue served before it; the last entry is the end
        self.first, self.served = [0], [[0] * len(totals)]
        for end in _phases(totals, targets):
            tokens = sum(end) - sum(self.served[-1])
            self.first.append(self.first[-1] + max(1, round(tokens / (length * epoch))))
            self.served.append(end)
        self.n = self.first[-1]
        self._cache: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def bounds(self, queue: int, e: int) -> int:
        j = min(bisect.bisect_right(self.first, e), len(self.first) - 1) - 1
        low, high = self.served[j][queue], self.served[j + 1][queue]
        return low + (high - low) * (e - self.first[j]) // (self.first[j + 1] - self.first[j])

    def epoch_of(self, queue: int, position: int) -> int:
        j = bisect.bisect_right(self.served, position, key=lambda s: s[queue]) - 1
        low, high = self.served[j][queue], self.served[j + 1][queue]
        e = self.first[j] + (position - low) * (self.first[j + 1] - self.first[j]) // (high - low)
        while self.bounds(queue, e + 1) <= position:
            e += 1
        while self.bounds(queue, e) > position:
            e -= 1
        return e

    def cuts(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        """For each queue the tokens served before each sequence (from 0), and its offset in each sequence."""
        if e not in self._cache:
            if len(self._cache) >= self.most:
                self._cache.popitem(last=False)
            self._cache[e] = self._serve(np.array([self.bounds(q, e + 1) - self.bounds(q, e) for q in range(len(self.totals))], np.int64))
        self._cache.move_to_end(e)
        return self._cache[e]

    def _serve(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        served = np.array(list(_rounds(tokens, self.length)), np.int64).reshape(-1, len(tokens))
        before = np.zeros((len(served) + 1, len(tokens)), np.int64)
        np.cumsum(served, axis=0, out=before[1:])
        return before.T.copy(), (np.cumsum(served, axis=1) - served).T.copy()


def _phases(totals: list[int], targets: list[float] | None) -> Iterator[list[int]]:
    """The tokens of each queue served at the end of each phase."""
    if targets is not None and any(targets):
        dry = [t / w if w else np.inf for t, w in zip(totals, targets)]
        before = None
        for at in sorted({d for d in dry if d < np.inf}):
            end = [t if d <= at else min(t - 1, int(w * at)) for t, w, d in zip(totals, targets, dry)]
            if end != before:
                yield end
            before = end
        if before == totals:
            return
    if totals:
        yield list(totals)


def _rounds(tokens: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The tokens that each queue gives to each sequence of an epoch."""
    left, total = tokens.copy(), int(tokens.sum())
    credit = tokens / max(1, total) * length
    deficit = np.zeros(len(tokens))
    while total:
        room = min(length, total)
        deficit += credit
        now = np.minimum(np.floor(deficit).clip(min=0).astype(np.int64), left)
        over = int(now.sum()) - room
        while over:  # fill up from the largest credits, or take back from the smallest
            able = now < left if over < 0 else now > 0
            order = np.argsort(np.where(able, now - deficit, np.inf) if over < 0 else np.where(able, deficit - now, np.inf), kind="stable")
            order = order[:min(abs(over), int(able.sum()))]
            now[order] += 1 if over < 0 else -1
            over = int(now.sum()) - room
        deficit -= now
        left -= now
        total -= room
        yield now


def pack(docs: DataFrame, tokenizer_json: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         length: int = 2048, end_id: int = 1, epoch: int = 512, max_queues: int = 1024, broadcast_rows: int = 300_000,
         targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, unsigned 32-bit, little-endian).

    tokenizer_json, ranks and pattern: the vocabulary file, and optionally the same vocabulary as a rank file with its pattern.
    targets: the share of tokens wanted of each source, in any unit; a ValueError where there are more than max_queues sources.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rank_file = None
    if ranks is not None:
        with open(ranks, "rb") as f:
            rank_file = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    queue = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null"))
    many = docs.select(queue.alias("s")).distinct().limit(max_queues + 1).count() > max_queues

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value, rank_file and rank_file.value, pattern)
        end = np.array([end_id], encoder.type).tobytes()
        width = len(end)
        part = TaskContext.get().partitionId()
        before: dict[str, int] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                texts = [t or "" for t in s.column(2).to_pylist()]
                ids = [x + end for x in encoder.encode(texts)]
                n = [len(x) // width for x in ids]
                at = []
                for q, k in zip(s.column(1).to_pylist(), n):
                    at.append(before.get(q, 0))
                    before[q] = at[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array([part] * s.num_rows, pa.int32()), pa.array(n, pa.int64()),
                     pa.array(at, pa.int64()), pa.array(ids, pa.binary())], ["id", "queue", "part", "n", "at", "ids"])

    tokens = materialize(docs.select(F.col(id_col).alias("id"), queue.alias("queue"), F.col(text_col).alias("text")).mapInArrow(
        encode, f"id {kind}, queue string, part int, n long, at long, ids binary"))
    parts = tokens.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    if many and targets:
        raise ValueError(f"targets can be met for {max_queues} sources at most; raise max_queues or name fewer sources")
    if many:
        return _by_epoch(tokens, parts, length, epoch, kind).withColumnRenamed("id", id_col)
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most max_queues rows
    names = sorted(totals)
    number = {q: k for k, q in enumerate(names)}
    wanted = {"\x00null" if q is None else q: w for q, w in (targets or {}).items()}
    plan = Epochs([totals[q] for q in names], length, epoch, [wanted.get(q, 0.0) for q in names] if targets else None)
    order = Window.partitionBy("queue").orderBy("part")
    offsets = parts.select("part", "queue", (F.sum("n").over(order) - F.col("n")).alias("base"))
    offsets = materialize(offsets)
    # a task that reads the queues side by side needs the cuts of as many epochs as the queues are apart; where memory holds
    # them, the ids stay where they are, else they are shuffled so that a queue's documents lie together
    few = plan.most >= 128 and offsets.count() <= broadcast_rows
    placed = tokens.join(F.broadcast(offsets) if few else offsets, ["part", "queue"]).select("id", "queue", (F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                rows = _pieces(plan, [number[q] for q in s.column(1).to_pylist()], s.column(2).to_pylist(), s.column(3).to_pylist(), s.column(4).to_pylist())
                take = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(take), *(pa.array(x, pa.int64()) for x in rows[1:-1]), pa.array(rows[-1], pa.binary())],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    out = placed.mapInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)


def _by_epoch(tokens: DataFrame, parts: DataFrame, length: int, epoch: int, kind: str) -> DataFrame:
    """The pieces of any number of queues: one group of rows an epoch, of about length * epoch tokens."""
    plan = Epochs([parts.agg(F.sum("n")).first()[0]], length, epoch)
    n_epochs, stride = plan.n, plan.stride
    same = Window.partitionBy("queue")
    offsets = materialize(parts.select(
        "part", "queue", (F.sum("n").over(same.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(same).alias("total")))
    placed = tokens.join(offsets, ["part", "queue"]).select("id", "queue", "total", (F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                row, number, here, start, held = [], [], [], [], []
                for k, (total, at, n, raw) in enumerate(zip(*(s.column(c).to_pylist() for c in (2, 3, 4, 5)))):
                    width, done, one = len(raw) // n, 0, Epochs([total], length, epoch)
                    one.first[-1] = one.n = n_epochs
                    while done < n:
                        e = one.epoch_of(0, at + done)
                        stop = min(n, one.bounds(0, e + 1) - at)
                        row.append(k)
                        number.append(e)
                        here.append(at + done - one.bounds(0, e))
                        start.append(done)
                        held.append(raw[width * done:width * stop])
                        done = stop
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(take), s.column(1).take(take), *(pa.array(x, pa.int64()) for x in (number, here, start)),
                     s.column(4).take(take), pa.array([width] * len(row), pa.int32()), pa.array(held, pa.binary())],
                    ["id", "queue", "epoch", "here", "start", "n", "width", "ids"])

    def serve(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_pylist() for c in ("queue", "epoch", "here", "start", "n", "width", "ids")}
        number = {q: k for k, q in enumerate(sorted(set(col["queue"])))}
        counts = np.zeros(len(number), np.int64)
        queues = np.array([number[q] for q in col["queue"]], np.int64)
        np.add.at(counts, queues, [len(x) // w for x, w in zip(col["ids"], col["width"])])
        cells = []  # sequence, queue, tokens, offset: at most one a token
        for s, now in enumerate(_rounds(counts, length)):
            some = np.flatnonzero(now)
            k = now[some]
            cells.append(np.stack([np.full(len(some), s), some, k, np.cumsum(k) - k]))
        seq, of, got, offset = (cells := np.concatenate(cells, axis=1))[:, np.lexsort((cells[0], cells[1]))]
        first = np.searchsorted(of, np.arange(len(number)))
        before = np.cumsum(got) - got
        before -= before[first][of]
        row, *out = [[] for _ in range(8)]
        for k, q in enumerate(queues.tolist()):
            wide = np.frombuffer(col["ids"][k], np.uint16 if col["width"][k] == 2 else np.uint32).astype("<u4").tobytes()
            done, size, here = 0, len(wide) // 4, col["here"][k]
            end = first[q + 1] if q + 1 < len(first) else len(of)
            c = int(first[q] + np.searchsorted(before[first[q]:end], here, "right")) - 1
            while done < size:
                inside = here + done - int(before[c])
                k2 = min(size - done, int(got[c]) - inside)
                piece = wide[4 * done:4 * (done + k2)]
                row.append(k)
                for x, v in zip(out, (col["start"][k] + done, k2, zlib.crc32(piece), col["n"][k], col["epoch"][k] * stride + int(seq[c]),
                                      int(offset[c]) + inside, piece)):
                    x.append(v)
                done += k2
                c += 1
        return pa.Table.from_arrays(
            [t.column("id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in out[:-1]), pa.array(out[-1], pa.binary())],
            names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    pieces = placed.mapInArrow(cut, f"id {kind}, queue string, epoch long, here long, start long, n long, width int, ids binary")
    return pieces.groupBy("epoch").applyInArrow(
        serve, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def _pieces(plan: Epochs, queues: list[int], starts: list[int], sizes: list[int], ids: list[bytes]) -> list[list]:
    out: list[list] = [[] for _ in range(8)]
    row, start, length, crc, total, sequence, offset, held = out
    for k, (q, at, n, raw) in enumerate(zip(queues, starts, sizes, ids)):
        wide = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4").tobytes()
        done = 0
        while done < n:
            e = plan.epoch_of(q, at + done)
            base = plan.bounds(q, e)
            before, offsets = plan.cuts(e)
            mine = before[q]
            stop = min(n, plan.bounds(q, e + 1) - at)
            s = int(np.searchsorted(mine, at + done - base, "right")) - 1
            while done < stop:
                here = at + done - base
                k2 = min(stop - done, int(mine[s + 1]) - here)
                if k2 > 0:
                    piece = wide[4 * done:4 * (done + k2)]
                    row.append(k)
                    start.append(done)
                    length.append(k2)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    sequence.append(e * plan.stride + s)
                    offset.append(int(offsets[q, s]) + here - int(mine[s]))
                    held.append(piece)
                    done += k2
                s += 1
    return out


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
               public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
