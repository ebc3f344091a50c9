"""One query for each operator of this subpackage, over its whole tables, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import importance

    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import katz

    return katz.score(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import spans

    return spans.deduplicate(_table(spark, sf_dir, "documents"), removed_col="n_removed").select("doc_id", "text", "n_removed")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import chat

    return chat.prefix_targets(_table(spark, sf_dir, "conversations"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import vafile

    vectors = _table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, k=10, queries=vectors.where("vec_id % 100 = 0"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import decontaminate

    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity

    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import simhash

    return simhash.duplicates(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import bpe

    return bpe.encode(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_katz_backoff,
        op3_substring_dedup,
        op4_language_id,
        op5_chat_prefix_targets,
        op6_exact_top_k,
        op7_decontamination,
        op8_toxicity,
        op9_simhash_dedup,
        op10_bpe,
    )
}
