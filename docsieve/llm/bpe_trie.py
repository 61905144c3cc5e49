"""Byte-pair encoding and decoding, with shared prefixes of words encoded once.

What makes prefixes worth sharing: in an encoding, no merge ever crosses the cut between two neighbouring tokens, and whether one
does depends on these two tokens alone (`BytePairs.outlives`). So the encoding of a word without its last token is the encoding of
that shorter word, and a prefix's encoding is known by its last token: it is the only vocabulary entry at the prefix's end whose cut
to the last token of the prefix before it outlives all merges.

Distinct pre-tokens of a batch form a trie, laid out in depth-first order. The walk gives every node its last token from the last
tokens of the nodes above it, once however many words pass through it; a word's tokens are then read backwards from its end. Words
whose last symbol is marked (end-of-word suffixes) share all but that symbol. Only the path from the root to the present node is
held, so memory is bounded by the batch and its longest word.

The texts themselves go through the vocabulary's own normalizer and cutter. Ids are gathered from the ids of chunks already met.

Defined results: a null or empty text has no ids and decodes to the empty string; each row is encoded by itself, repeated rows and
null ids included; special tokens inside texts are single ids, as the library has it by default; texts of any length are taken
whole; null ids arrays decode to the empty string, and an id that isn't in the vocabulary is an error of the row's task; columns
other than those named are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices
from .token_counts import byte_chars

_LAST = 256  # added to the byte that ends a word, where the vocabulary marks ends
_NEVER = 1 << 60


class BytePairs:
    """The merges of a vocabulary: last tokens of prefixes, and encodings of words through a trie."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "", remember: int = 500_000):
        self.remember = remember
        self.mark = _LAST if suffix else 0
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        self.width = max(vocab.values()) + 1
        symbols: dict[int, tuple[int, ...]] = {}
        for b, c in enumerate(byte_chars()):
            symbols[vocab[c]] = (b,)
            if suffix:
                symbols[vocab[c + suffix]] = (b + _LAST,)
        self.rank = dict.fromkeys(symbols, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[int, int] = {}
        for r, (x, y) in enumerate(pairs):
            a, b, new = vocab[x], vocab[y], vocab[x + y]
            if new in self.rank or a not in self.rank or b not in self.rank:
                raise ValueError(f"merge {r} ({x!r}, {y!r}) doesn't make a new token of earlier ones")
            self.rank[new], self.parts[new], symbols[new] = r, (a, b), symbols[a] + symbols[b]
            self.pair[a * self.width + b] = r
        self.length = {t: len(s) for t, s in symbols.items()}
        self._spines: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        self._cuts: dict[int, bool] = {}
        # vocabulary entries from their last symbol backwards, as one table of edges; entries that merging never leaves stay out
        self.edges: dict[int, int] = {}
        self.entry = [-1]
        sound = set()
        for t in sorted(symbols, key=self.rank.__getitem__):
            if t in self.parts:
                a, b = self.parts[t]
                if a not in sound or b not in sound or not self._survives(a, b, self.rank[t]):
                    continue
            sound.add(t)
            at = 0
            for s in reversed(symbols[t]):
                key = at << 9 | s
                if key not in self.edges:
                    self.edges[key] = len(self.entry)
                    self.entry.append(-1)
                at = self.edges[key]
            self.entry[at] = t

    def _spine(self, t: int, side: int) -> tuple[list[int], list[int]]:
        """The tokens that lie at one side of t while it grows, and for each the rank of the merge that takes it up."""
        if (t, side) not in self._spines:
            grown = [t]
            while grown[-1] in self.parts:
                grown.append(self.parts[grown[-1]][side])
            grown.reverse()
            self._spines[t, side] = grown, [*(self.rank[x] for x in grown[1:]), _NEVER]
        return self._spines[t, side]

    def _survives(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge of a rank below `until` crosses the cut between a and b while both grow from their symbols."""
        left, left_up = self._spine(a, 1)
        right, right_up = self._spine(b, 0)
        i = j = 0
        while True:
            q, up_l, up_r = self.pair.get(left[i] * self.width + right[j], _NEVER), left_up[i], right_up[j]
            if q < until and q < up_l and q <= up_r:  # of equal pairs that overlap, the left one is merged
                return False
            if up_l == up_r == _NEVER:
                return True
            if up_l <= up_r:
                i += 1
            else:
                j += 1

    def outlives(self, a: int, b: int) -> bool:
        """Whether the cut between tokens a and b outlives all merges."""
        key = a * self.width + b
        known = self._cuts.get(key)
        if known is None:
            if len(self._cuts) >= self.remember:
                self._cuts.clear()
            known = self._cuts[key] = self._survives(a, b)
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; the words are distinct and not empty.

        In alphabetical order the words are the trie's branches from left to right: what a word has in common with the one before is the
        part of its path that was walked already, and the rest are its new nodes, which follow depth first. `state` holds the last tokens
        along the path, so memory is that of one word, however many nodes the trie has.
        """
        out: list[list[int]] = [[]] * len(words)
        edges, entry, cuts, width, length, mark = self.edges, self.entry, self._cuts, self.width, self.length, self.mark
        state, before = array("i", [0]), b""
        for number in sorted(range(len(words)), key=words.__getitem__):
            word = words[number]
            n = len(word)
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            if mark:  # the last symbol of a word is another one than inside
                shared = min(shared, n - 1, len(before) - 1) if before else 0
            if len(state) <= n:
                state.extend([0] * (n + 1 - len(state)))
            for d in range(shared, n):
                at = edges[word[d] + mark if d == n - 1 else word[d]]
                k = d
                while True:
                    t = entry[at]
                    if t >= 0:
                        if not k:
                            break
                        key = state[k] * width + t
                        good = cuts.get(key)
                        if good is None:
                            good = self.outlives(state[k], t)
                        if good:
                            break
                    k -= 1
                    at = edges[at << 9 | word[k]]
                state[d + 1] = t
            ids, d = [], n
            while d:
                t = state[d]
                ids.append(t)
                d -= length[t]
            ids.reverse()
            out[number], before = ids, word
        return out


class TrieEncoder:
    """Ids of whole texts as the `tokenizers` library gives them for a byte-level vocabulary file without begin or end tokens."""

    def __init__(self, spec: str, remember: int = 150_000):
        import regex
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        self.pairs = BytePairs(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        own = Tokenizer.from_str(spec)
        self.normal = own.normalizer.normalize_str if own.normalizer else str
        self.cut = own.pre_tokenizer.pre_tokenize_str
        self.back = {c: b for b, c in enumerate(byte_chars())}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # a cutter that keeps only what its pattern finds, and finds no white space, can be asked for each chunk between white space
        cutters = parsed["pre_tokenizer"].get("pretokenizers", [{}])
        first = cutters[0]
        self.find = None
        if first.get("behavior") == "Removed" and first.get("invert"):
            pattern = regex.compile(first["pattern"]["Regex"])
            if not pattern.search(" \t\n\v\f\r"):
                self.find = regex.compile(first["pattern"]["Regex"] + "|\n").findall
        # chunks that may hold a special token, or characters that normalizing could compose or lower-case by more than one rule
        self.apart = re.compile(b"|".join([b"[\xcc-\xff]", *(re.escape(c.encode()) for c in self.special)])).search
        self.lowers = '"Lowercase"' in json.dumps(parsed["normalizer"])
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _cut(self, chunks: list[bytes]) -> list[list]:
        """Each chunk in order: pre-tokens, and ids of special tokens."""
        plain = [] if self.find is None else [c for c in chunks if not self.apart(c)]
        out: dict[bytes, list] = {}
        if plain:  # cut all at once, at line ends, which no chunk has
            text = b"\n".join(plain).decode() + "\n"
            found, at = self.find(text.lower() if self.lowers else text), 0
            for c in plain:
                end = found.index("\n", at)
                out[c] = found[at:end]
                at = end + 1
        for c in chunks:
            if c not in out:
                text, at, parts = c.decode(), 0, []
                for m in self.specials.finditer(text) if self.specials else ():
                    parts += [*self._pieces(text[at:m.start()]), self.special[m[0]]]
                    at = m.end()
                out[c] = parts + self._pieces(text[at:])
        return [out[c] for c in chunks]

    def _pieces(self, text: str) -> list[str]:
        return [bytes(map(self.back.__getitem__, x)).decode("utf-8", "surrogateescape") for x, _ in self.cut(self.normal(text))] if text else []

    def _learn(self, chunks: list[bytes]) -> None:
        parts = self._cut(chunks)
        words = self.words
        new = list({w for p in parts for w in p if w not in words and type(w) is str})
        got = self.pairs.encode_words([w.encode("utf-8", "surrogateescape") for w in new])
        words.update((w, array("i", ids).tobytes()) for w, ids in zip(new, got))
        ids = [words[p[0]] if len(p) == 1 and type(p[0]) is str else b"".join(array("i", (w,)).tobytes() if type(w) is int else words[w] for w in p) for p in parts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.known.update(zip(chunks, range(len(self.start), len(self.start) + len(chunks))))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(sizes) - sizes]
        self.size = np.r_[self.size, sizes]
        self.flat = np.r_[self.flat, np.frombuffer(b"".join(ids), np.int32)]
        if len(words) > self.remember:
            words.clear()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        split = [t.split() for t in texts] if self.find else [[t] if t else [] for t in texts]
        if len(self.known) > self.remember or len(self.flat) > 10 * self.remember:
            self._forget()
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(list(new))
        code = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        size = self.size[code]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        if not self.find:  # whole texts don't come again
            self.known.clear()
            self.start, self.size, self.flat = self.start[:0], self.size[:0], self.flat[:0]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum([len(s) for s in split], dtype=np.int64)]]
        return ids, np.diff(bounds)


@functools.lru_cache(maxsize=2)
def _encoder(spec: str) -> TrieEncoder:
    return TrieEncoder(spec)  # tables of a vocabulary, once a worker


@functools.lru_cache(maxsize=2)
def _token_strings(spec: str) -> tuple[np.ndarray, bool]:
    """The string of each id, and whether they stand for bytes that are joined."""
    parsed = json.loads(spec)
    vocab = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
    kind = (parsed["decoder"] or {}).get("type")
    if kind not in (None, "ByteLevel"):
        raise ValueError(f"a decoder of type {kind} isn't known")
    out = np.empty(max(vocab.values()) + 1, object)
    back = {c: b for b, c in enumerate(byte_chars())}
    for text, k in vocab.items():
        if kind is None:
            out[k] = text
        else:
            out[k] = bytes(map(back.__getitem__, text)) if all(c in back for c in text) else text.encode()
    return out, kind is not None


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _texts(strings: np.ndarray, joined: bool, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The decoded text of each run of ids."""
    ends = np.cumsum(sizes)
    out = []
    for lo, hi in zip((ends - sizes).tolist(), ends.tolist()):
        own = strings[flat[lo:hi]].tolist()
        out.append(b"".join(own).decode(errors="replace") if joined else " ".join(own))
    return out


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row a document: the id and `ids`, an array of ints, without begin or end tokens; with `decoded`, also the text they decode to.

    tokenizer_json is the path of a vocabulary file on the driver; its content (under 4 MB, a fixed size) is broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_read(tokenizer_json))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for b in batches:
            for lo, texts in text_slices(b.column(1)):
                ids, sizes = encoder.encode(texts)
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                more = [pa.array(_texts(*_token_strings(spec.value), ids, sizes), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), *more], names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer_json: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each of rows: the id, the ids and `decoded`, their text as the library's decode gives it, special tokens kept."""
    spec = rows.sparkSession.sparkContext.broadcast(_read(tokenizer_json))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, joined = _token_strings(spec.value)
        for b in batches:
            lists = b.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(sizes)]
            for lo in range(0, len(sizes), 256):
                part = b.slice(lo, 256)
                texts = _texts(strings, joined, flat[ends[lo]:ends[lo + part.num_rows]], sizes[lo:lo + part.num_rows])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    out = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")


def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = encode(table(spark, sf_dir, "documents"), path, decoded=True)  # in one pass; decode() alone starts from ids
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
                      digest(F.col("decoded")).alias("decoded_sha256"))
