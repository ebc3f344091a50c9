"""Graphs on disk: each save is a new version; a reader sees a whole version or none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from graphloom.errors import GraphError
from graphloom.graph import PropertyGraph


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    jvm, fs = _fs(spark, folder)
    p = jvm.org.apache.hadoop.fs.Path(folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def save(graph: PropertyGraph, folder: str) -> int:
    """Writes both tables beside the versions, then renames them into place; the number of the new version."""
    spark = graph.spark
    jvm, fs = _fs(spark, folder)
    work = f"{folder}/.{uuid.uuid4().hex}"
    for name, t in (("nodes", graph.nodes_table), ("edges", graph.edges_table)):
        writer = t.write.partitionBy(graph.graph_col) if graph.graph_col else t.write
        writer.parquet(f"{work}/{name}")
    schemas = [(t.schema.json(),) for t in (graph.nodes_table, graph.edges_table)]
    spark.createDataFrame([(0, *schemas[0]), (1, *schemas[1])], "i int, schema string").coalesce(1).write.parquet(f"{work}/schemas")
    version = max(versions(spark, folder), default=0) + 1
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(work), jvm.org.apache.hadoop.fs.Path(f"{folder}/v{version}")):
        raise GraphError(f"version {version} was saved by someone else")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None, **how) -> PropertyGraph:
    """A saved version, the last by default."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise GraphError(f"there is no version {version or ''} in {folder}")
    at = f"{folder}/v{version or known[-1]}"
    saved = {r["i"]: T.StructType.fromJson(json.loads(r["schema"])) for r in spark.read.parquet(f"{at}/schemas").collect()}
    # a table partitioned by graph may have no file at all, so its schema is kept beside it
    nodes, edges = (spark.read.schema(saved[i]).parquet(f"{at}/{name}") for i, name in enumerate(("nodes", "edges")))
    return PropertyGraph.create(nodes, edges, **how)
