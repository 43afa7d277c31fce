"""The training-data pipeline over documents: each stage applies one operator to all that the stage before kept.

1. quality rules: documents that the rules reject go.
2. line dedup: later copies of repeated runs of lines go from the texts, and documents that are nothing else go.
3. n-gram Jaccard join: of each group of near duplicates one document stays.
4. mixing: documents appear as often as the mix of their source takes them, in whole documents.
5. BPE encoding and decoding: numbers of tokens and digests of the ids and the decoded text.

Nulls, empty and very long texts, repeated rows and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm import bpe, line_dedup, mixing, ngram_join, quality
from readmill.llm.common import documents, forget, written
from readmill.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary(), keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: Expectation-maximisation and byte-pair merges have no SQL form; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)  # later stages read what was written last
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
