"""What several operators share: tables, the shared folder, word splitting and hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clean_up, exists, materialize, shared_dir, tidy  # noqa: F401

#: ASCII white space; the words of a text are the runs of other characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """docs, if its ids are integers."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer column, but is {kind}; number the documents first")
    return docs


def text_slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 of the texts) for rows of about `most` bytes together."""
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k, n in enumerate(size.tolist()):
        held += n
        if held >= most or k + 1 == len(size):
            yield lo, [t or b"" for t in column.slice(lo, k + 1 - lo).cast(pa.binary()).to_pylist()]
            lo, held = k + 1, 0


def words_col(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_table(keep: bytes, lower: bool = True) -> bytes:
    """For bytes.translate: bytes outside `keep` become spaces, A-Z become a-z if asked."""
    kept = set(keep)
    return bytes((b + 32 if lower and 65 <= b <= 90 else b) if b in kept else 32 for b in range(256))


#: Words of letters, digits and non-ASCII characters, lower-cased in A-Z only.
ALNUM = word_table(bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum()))
#: Every byte as it is, but A-Z lower-cased; bytes.split() then cuts at ASCII white space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: a run of 2w words is hashed from two runs of w words
    out, done, width, power = None, 0, 1, h
    while True:
        if k & width:
            part = power[done:done + n]
            out = mix64(part) if out is None else mix64(out * _MUL + part)
            done += width
        if done == k:
            return out
        power = mix64(power[:-width] * _MUL + (power[width:] ^ np.uint64(width)))
        width *= 2


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the low bits of the long column `key`: 2**bits bits reach the driver at most, whatever the number of keys."""
    rows = (keys.select(F.expr(f"shiftright(key & {(1 << bits) - 1}L, 6)").alias("w"), F.expr("shiftleft(1L, cast(key & 63L as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set: true for all keys put in, and for few others while the bitmap is sparse."""
    slot = keys & np.uint64(len(bits) * 64 - 1)
    return (bits.view(np.uint64)[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        path = []
        while (p := parent.setdefault(a, a)) != a:
            path.append(a)
            a = p
        for x in path:
            parent[x] = a
        return a

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "label"])


def components(edges: DataFrame, local: int = 1_000_000) -> DataFrame:
    """Connected components of the long pairs (a, b): rows (node, label), label the smallest node of the component.

    Up to `local` distinct pairs (under 200 MB) are joined by one task; more go through large-star and small-star steps in turn,
    until the edges are stars, and every round is a written table.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= local:
        return materialize(edges.coalesce(1).mapInArrow(_union_find, "node long, label long"))
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
