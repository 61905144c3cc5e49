"""Token counts by rank-synchronous merging of ragged symbol arrays.

The texts of a batch are cut into pre-tokens. The pre-tokens not met before are held together as one flat array of symbols
with the number of the sequence of each; every round finds the lowest-ranked pair of each sequence and merges all its places
at once, until no sequence has a pair with a rank. The symbols left are the tokens.

Defined results: a null or empty text has 0 bytes and 0 tokens; each row is counted by itself, repeated rows and null ids
included; columns other than the id and the text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_NONE = np.int64(1 << 60)


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class RankMerger:
    """Counts the symbols that byte-pair merging leaves of each word."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        chars = byte_chars()
        self.width = max(vocab.values()) + 1
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], order.astype(np.int64), new

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = sizes.copy()
        raw = np.frombuffer(b"".join(words), np.uint8)
        seq = np.repeat(np.arange(len(words)), sizes)
        sym = self.inner[raw]
        ends = (np.cumsum(sizes) - 1)[sizes > 0]
        sym[ends] = self.last[raw[ends]]
        if len(sym) < 2:
            return out
        # the rank of each symbol with the next one of its word
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        while True:
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(seq)])
            alive = low < _NONE
            if not alive.all():  # the words that are done leave
                out[seq[first[~alive]]] = size[~alive]
                keep = np.repeat(alive, size)
                sym, seq, rank, low, size = sym[keep], seq[keep], rank[keep], low[alive], size[alive]
                if not len(sym):
                    return out
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # of places that overlap (a a a), every second one of a run is merged, from the left
            if len(hit) > 1:
                start = np.r_[True, np.diff(hit) != 1]
                at = np.arange(len(hit))
                hit = hit[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0]
            sym[hit] = self.new[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            again = moved[hit]
            near = np.zeros(len(sym) + 1, bool)
            near[again] = near[again - 1] = True
            again = np.flatnonzero(near[:-1])
            ok = np.zeros(len(again), bool)
            inner = again + 1 < len(seq)
            ok[inner] = seq[again[inner]] == seq[again[inner] + 1]
            rank[again] = _NONE
            rank[again[ok]] = self.ranks(sym[again[ok]], sym[again[ok] + 1])


class TokenCounter:
    """Token counts for a vocabulary file of the `tokenizers` library whose words end in a suffix."""

    def __init__(self, spec: str, remember: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        self.merger = RankMerger(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        pattern = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in parsed["added_tokens"]))
        self.marks = tuple(t["content"].encode() for t in parsed["added_tokens"])
        self.mark = os.path.commonprefix(list(self.marks))
        own = Tokenizer.from_str(spec)
        self.normal, self.cut = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.back = {c: b for b, c in enumerate(byte_chars())}
        self.known: dict[bytes, int] = {}
        self.remember = remember

    def pieces(self, text: str) -> list[bytes]:
        """Pre-tokens of a text without special tokens or white space at which it could be cut."""
        if max(text, default="") < "̀":  # composed already, and lower case goes by single characters
            return [x.encode() for x in self.find(text.lower())]
        # elsewhere the library's own normalizer and cutter serve; the merges are done here
        return [bytes(map(self.back.__getitem__, x)) for x, _ in self.cut(self.normal(text))]

    def learn(self, chunks: list[bytes]) -> None:
        words: list[bytes] = []
        owner: list[int] = []
        extra = np.zeros(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            text = c.decode()
            parts = [text]
            if self.mark in c and any(m in c for m in self.marks):
                extra[i] = len(self.special.findall(text))
                parts = self.special.split(text)
            for part in parts:
                if part:
                    found = self.pieces(part)
                    words += found
                    owner += [i] * len(found)
        if words:
            np.add.at(extra, owner, self.merger.counts(words))
        self.known.update(zip(chunks, extra.tolist()))

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """UTF-8 bytes and tokens of each text."""
        raw = [(t or "").encode() for t in texts]
        tokens = []
        for lo, hi in _slices(raw):
            split = [r.split() for r in raw[lo:hi]]
            if len(self.known) > self.remember:
                self.known.clear()
            new = set().union(*split).difference(self.known)
            if new:
                self.learn(list(new))
            get = self.known.__getitem__
            tokens += [sum(map(get, s)) for s in split]
        return [len(r) for r in raw], tokens


def _slices(raw: list[bytes], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, so that the arrays stay small."""
    lo, held = 0, 0
    for i, r in enumerate(raw):
        held += len(r)
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(raw):
        yield lo, len(raw)


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row a document: the id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    tokenizer_json is the path of a vocabulary file on the driver; its content (1.7 MB, a fixed size) is broadcast.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(spec.value)
        for b in batches:
            n_bytes, n_tokens = counter.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
