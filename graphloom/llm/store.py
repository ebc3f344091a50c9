"""Lineage cuts and small helpers shared by the operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import lineage

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Deletes every table written so far; frames still reading them become invalid.
release = lineage.release


def written(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once and survives lost executors.

    ``by`` partitions the table's files by a column. The shuffle files of the write are given back when it ends, and those
    that nothing refers to any more.
    """
    spark = df.sparkSession
    path = lineage.temporary(spark, name)
    schema = df.schema
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, marked to be broadcast if it has been counted to have no more than ``most`` rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    name, i = f"__{base}", 0
    while name.lower() in taken:
        i += 1
        name = f"__{base}_{i}"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id BIGINT, text STRING): extra columns never reach an operator."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id; null and empty texts count as the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
