"""The training-data operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import audio, bpe, centroids, chat, decontaminate, fim, mainart, neardup, quality, sstable, substring, toxicity, warc
from folioscope.llm.common import table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def rank_map() -> bpe.RankMap:
    return bpe.RankMap.read(vocabulary("byte_bpe_multi_50k.tiktoken"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), rank_map(), pattern())


def op2_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainart.extract(table(spark, sf_dir, "pages"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digest(chat.format_conversations(turns))


def op11_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.report(table(spark, sf_dir, "documents"))


def op12_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_byte_bpe, op2_sorted_string_table, op3_page_differencing, op4_superminhash, op5_warc_normaliser, op6_toxicity, op7_decontamination, op8_quality_rules,
            op9_substring_dedup, op10_chat_formatting, op11_audio_features, op12_elkan_clusters, op13_fill_in_middle,
        )
    }


def oracle_sql() -> dict[str, str]:
    from folioscope.llm import oracles

    return oracles.SQL
