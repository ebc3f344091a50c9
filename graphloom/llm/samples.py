"""Bounded samples of labelled rows, the only thing a classifier here is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, column: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y): up to ``most`` labelled ids, those with the smallest hashes; labels other than 0 and 1 don't count.

    An id that is labelled both ways counts as 1. The result is as large as ``most`` at the most, so it may be broadcast.
    """
    rows = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[column].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sampled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, y): the documents of a bounded sample of ids."""
    return docs.join(F.broadcast(ids), "doc_id")
