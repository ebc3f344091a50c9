"""A property graph over a directory of order, event and embedding tables.

Node ids are key * 16 + a code of the type; edge ids likewise with a code of the kind. Each type of node and kind of edge is a
branch of a union with a literal ``type`` or ``kind``, so a filter on it prunes all other branches, and other filters and the
columns needed go down to the Parquet scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, USER, EVENT, VECTOR, TURN = 1, 2, 3, 4, 5, 6, 7, 8, 12, 13


def node_id(key: str | Column, code: int) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("long") * 16 + code


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _packed(a: Column, b: Column) -> Column:
    """Two keys in one; larger keys than there is room for are refused, as their ids would be those of other edges."""
    fits = (b >= 0) & (b < 1 << 24) & (a >= 0) & (a < 1 << 35)
    return F.when(fits, a * (1 << 24) + b).otherwise(F.raise_error(F.lit("keys are too large for edge ids of 64 bits")).cast("long"))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders, users and events, and the edges between them; acyclic."""

    def table(name: str) -> DataFrame:
        return read(spark, folder, name)

    def nodes(name: str, kind: str, key: str, code: int) -> DataFrame:
        return table(name).select(node_id(key, code).alias("id"), F.lit(kind).alias("type"), "*")

    def edges(rows: DataFrame, kind: str, code: int, key: Column, start: Column, end: Column, *extra: str) -> DataFrame:
        return rows.select((key * 16 + code).alias("id"), start.alias("start_id"), end.alias("end_id"), F.lit(kind).alias("kind"), *extra)

    events = table("events")
    all_nodes = _union([
        nodes("region", "region", "r_regionkey", REGION),
        nodes("nation", "nation", "n_nationkey", NATION),
        nodes("customer", "customer", "c_custkey", CUSTOMER),
        nodes("supplier", "supplier", "s_suppkey", SUPPLIER),
        nodes("part", "part", "p_partkey", PART),
        nodes("orders", "order", "o_orderkey", ORDER),
        events.select(node_id("user_id", USER).alias("id"), F.lit("user").alias("type"), "user_id").distinct(),
        nodes("events", "event", "event_id", EVENT),
    ])
    # an order line isn't unique by its number: lines of one order, number and part are one edge
    lines = table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    line_key = _packed(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_partkey"))
    supplied = table("lineitem").select("l_partkey", "l_suppkey").distinct()
    all_edges = _union([
        edges(table("nation"), "in_region", 1, F.col("n_nationkey").cast("long"), node_id("n_nationkey", NATION), node_id("n_regionkey", REGION)),
        edges(table("customer"), "in_nation", 2, F.col("c_custkey"), node_id("c_custkey", CUSTOMER), node_id("c_nationkey", NATION)),
        edges(table("supplier"), "in_nation", 3, F.col("s_suppkey"), node_id("s_suppkey", SUPPLIER), node_id("s_nationkey", NATION)),
        edges(table("orders"), "placed", 4, F.col("o_orderkey"), node_id("o_custkey", CUSTOMER), node_id("o_orderkey", ORDER)),
        edges(lines, "contains", 5, line_key, node_id("l_orderkey", ORDER), node_id("l_partkey", PART), "l_quantity", "l_discount"),
        edges(supplied, "supplied_by", 6, _packed(F.col("l_partkey"), F.col("l_suppkey")), node_id("l_partkey", PART), node_id("l_suppkey", SUPPLIER)),
        edges(events, "performed", 7, F.col("event_id"), node_id("user_id", USER), node_id("event_id", EVENT)),
    ])
    return PropertyGraph.create(all_nodes, all_edges, acyclic=True)


def event_bags(spark: SparkSession, folder: str) -> PropertyGraph:
    """Events and users with their properties in bags: an event's is its JSON and its type and value."""
    events = read(spark, folder, "events")
    bag = F.parse_json(F.to_json(F.struct(F.lit("event").alias("type"), F.col("event_type"), F.col("value"), F.get_json_object("props", "$.k").cast("int").alias("k"))))
    nodes = events.select(node_id("event_id", EVENT).alias("id"), bag.alias("properties"))
    users = events.select("user_id").distinct()
    nodes = nodes.unionByName(users.select(node_id("user_id", USER).alias("id"), F.parse_json(F.to_json(F.struct(F.lit("user").alias("type"), "user_id"))).alias("properties")))
    edges = events.select((F.col("event_id") * 16 + 7).alias("id"), node_id("user_id", USER).alias("start_id"), node_id("event_id", EVENT).alias("end_id"), F.parse_json(F.to_json(F.struct(F.lit("performed").alias("kind")))).alias("properties"))
    return PropertyGraph.create(nodes, edges, acyclic=True)


def ring_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Customers, each with edges to three others of its nation's numbering: many cycles and parallel ways."""
    c = read(spark, folder, "customer")
    nodes = c.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("type"), "c_nationkey", "c_mktsegment", "c_acctbal")
    n = c.select(F.max("c_custkey").alias("n"))
    steps = F.explode(F.array(F.lit(1), F.lit(7), F.lit(-6))).alias("step")
    e = c.select("c_custkey", steps).crossJoin(F.broadcast(n))
    end = F.pmod(F.col("c_custkey") + F.col("step") - 1, F.col("n")) + 1
    edges = e.select((F.col("c_custkey") * 16 + F.col("step") + 6).alias("id"), F.col("c_custkey").alias("start_id"), end.alias("end_id"), F.lit("next").alias("kind"), "step")
    return PropertyGraph.create(nodes, edges, acyclic=False)


def vector_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Embeddings as nodes, with edges from each to the next two ids."""
    v = read(spark, folder, "embeddings")
    nodes = v.select(F.col("vec_id").alias("id"), F.lit("vec").alias("type"), "label", F.col("embedding").alias("vec_emb"))
    edges = v.select("vec_id", F.col("embedding").alias("vec_emb"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    last = v.select(F.max("vec_id").alias("last"))
    edges = edges.crossJoin(F.broadcast(last)).where("vec_id + step <= last")
    return PropertyGraph.create(nodes, edges.select((F.col("vec_id") * 4 + F.col("step")).alias("id"), F.col("vec_id").alias("start_id"), (F.col("vec_id") + F.col("step")).alias("end_id"), F.lit("next").alias("kind"), "step", "vec_emb"), acyclic=True)
