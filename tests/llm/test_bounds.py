"""What tasks and disks hold at once."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.llm import jaccard_join
from docsieve.storage import materialize

from .test_corpus_operators import family, frame


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_batches_for_python_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["bytes", "rows"])

    wide = spark.range(0, 48, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))  # 48 MB in one task
    got = wide.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in got) == 48 and max(r["bytes"] for r in got) < 12_000_000
    assert max(r["rows"] for r in spark.range(0, 9000, 1, 1).mapInArrow(sizes, "bytes long, rows long").collect()) <= 2000


def test_written_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert not shuffle_files(spark) - before
    assert out.count() == 10 and spark.conf.get(setting) == was


def test_frequent_tokens():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 20).astype(np.uint64)) for _ in range(9)]
    for some in (sets, sets[:3], []):
        tokens, count = np.unique(np.concatenate([*some, np.empty(0, np.uint64)]), return_counts=True)
        got = jaccard_join.frequent(some)
        assert got[0].tolist() == tokens[count >= 4].tolist() and got[1].tolist() == count[count >= 4].tolist()


@pytest.mark.parametrize("rounds", [1, 5])
def test_jaccard_join_in_rounds(spark, rounds):
    texts = family(random.Random(5), n=60)
    got = jaccard_join.jaccard_join(frame(spark, texts), percent=80, block=4, hot=3, rounds=rounds, round_rows=2).collect()
    sets = [set(jaccard_join.shingle_set(t, 3).tolist()) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))
