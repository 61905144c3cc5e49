"""A corpus from documents to training sequences, in stages that are each one operator of docsieve.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

Defined results: a null text is scored like an empty one, is never a copy of another, and is packed as the end token alone; ids must
be integers; rows with a null id go through all stages and stay even where they are copies; of rows with equal ids all stay or go
as copies, and the rest is done row by row; texts of any length are taken whole; an empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docsieve.deploy import ship
from docsieve.llm import decontamination, jaccard_join, packing, quality_classifier, secret_scans
from docsieve.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; shingles of five words, similarity 0.8 or more."""
    ship(spark)
    return jaccard_join.keep_first(docs, k=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    ship(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    ship(spark)
    return secret_scans.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are packed into sequences: one row a piece of a document."""
    ship(spark)
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("packing", sequences),
]

#: SQL can't express the classifier or the tokenizer; the tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialize(docs), sf_dir)
    return docs
