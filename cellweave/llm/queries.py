"""One query for each operator of this folder, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import chat, exact_dedup, graph_dedup, language, minhash, mixing, packing, pii, sharding, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"))


QUERIES |= {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_chat_formatting, op3_exact_dedup, op4_embedding_near_dedup, op5_pii, op6_sharding, op7_language_id, op8_mixing, op9_token_counts, op10_minhash_near_dedup)
}
ORACLES |= {
    "op2_chat_formatting": chat.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_embedding_near_dedup": graph_dedup.ORACLE,
    "op6_sharding": sharding.oracle(),
    "op8_mixing": mixing.ORACLE,
    "op10_minhash_near_dedup": minhash.ORACLE,
}
