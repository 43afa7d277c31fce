"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm import bpe, hard_negatives, html_extract, importance, line_dedup, merkle, mixing, ngram_join, quality, sharding, sql, substring_dedup, token_counts, token_stream
from readmill.llm.common import documents


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(documents(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary(), limit=2048)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary(), keep_ids=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("row")


def op8_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_stream.write_and_read(spark, documents(spark, sf_dir), vocabulary(), end_id=2)


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_neighbours(documents(spark, sf_dir))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.usable(vectors, label=label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extract, op2_substring_dedup, op3_line_dedup, op4_token_counts, op5_bpe, op6_quality_rules, op7_mixing, op8_token_stream, op9_merkle, op10_ngram_jaccard, op11_sharding, op12_importance, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    """The others encode with a vocabulary's merges, parse HTML or run expectation-maximisation: tests compare them with plain versions."""
    return dict(sql.ORACLE)
