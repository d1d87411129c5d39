"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import (
    centroids, chat, chunk_dedup, decontaminate, fill_middle, html_main, mixing, near_dup, packing, quality_bt, quality_rules, secret_scan, toxicity,
)
from twinfold.llm.common import documents, labels
from twinfold.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, f"{sf_dir}/conversations.parquet", "conv_id").select("conv_id", "turn", "role", "text")
    fixed = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(fixed).alias("text"))
    return chat.read_back(chat.examples(given.unionByName(probe)))


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir)).drop("text_hash", "stands")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.passages(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read_table(spark, f"{sf_dir}/pages.parquet", "page_id"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unsigned_crc32(packing.packed(documents(spark, sf_dir)))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(read_table(spark, f"{sf_dir}/embeddings.parquet", "vec_id"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_ranking": op1_quality_ranking,
        "op2_source_mixing": op2_source_mixing,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_minhash_near_dup": op4_minhash_near_dup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_html_extraction": op7_html_extraction,
        "op8_secret_scan": op8_secret_scan,
        "op9_toxicity": op9_toxicity,
        "op10_quality_rules": op10_quality_rules,
        "op11_packing": op11_packing,
        "op12_fill_middle": op12_fill_middle,
        "op13_centroids": op13_centroids,
    }
