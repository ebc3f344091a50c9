"""One query for each operator of the graph engine over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import ConstraintViolation
from graphloom.functions.filters import AND, BETWEEN, GT, GTE, LT, LTE, NOT, OR, HasKey
from graphloom.graph import PropertyGraph
from graphloom.operators import constraints, lineage, mutate, schema, vectors
from graphloom.operators.aggregates import Avg, Count, Max, Min, Sum
from graphloom.operators.rerank import Rerank
from graphloom.plans import json_spec
from graphloom.plans.specs import Boost, Hop, Near, Start
from graphloom.sources import registry, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


BUILDING = {"type": "customer", "c_mktsegment": "BUILDING"}
#: The tables as nodes and edges, for the SQL of walks over several kinds.
EDGES = """edges AS (
  SELECT CAST(n_nationkey AS BIGINT) * 16 + 1 AS id, CAST(n_nationkey AS BIGINT) * 16 + 2 AS s, CAST(n_regionkey AS BIGINT) * 16 + 1 AS t, 'in_region' AS kind, NULL::DOUBLE AS q FROM nation
  UNION ALL SELECT c_custkey * 16 + 2, c_custkey * 16 + 3, CAST(c_nationkey AS BIGINT) * 16 + 2, 'in_nation', NULL FROM customer
  UNION ALL SELECT s_suppkey * 16 + 3, s_suppkey * 16 + 4, CAST(s_nationkey AS BIGINT) * 16 + 2, 'in_nation', NULL FROM supplier
  UNION ALL SELECT o_orderkey * 16 + 4, o_custkey * 16 + 3, o_orderkey * 16 + 6, 'placed', NULL FROM orders
  UNION ALL SELECT ((l_orderkey * 8 + l_linenumber) * 16777216 + l_partkey) * 16 + 5, l_orderkey * 16 + 6, l_partkey * 16 + 5, 'contains', sum(l_quantity)
    FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey
  UNION ALL SELECT DISTINCT (l_partkey * 16777216 + l_suppkey) * 16 + 6, l_partkey * 16 + 5, l_suppkey * 16 + 4, 'supplied_by', NULL FROM lineitem
  UNION ALL SELECT event_id * 16 + 7, user_id * 16 + 7, event_id * 16 + 8, 'performed', NULL FROM events
)"""


def _one_hop(what: str) -> str:
    return f"""WITH e AS (SELECT o_orderkey * 16 + 4 AS id, c_custkey * 16 + 3 AS start_id, o_orderkey * 16 + 6 AS end_id
      FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F') {what}"""


_PLACED = (Start(where=BUILDING), Hop(via="placed", where={"o_orderstatus": "F"}))


@query("g_traverse_nodes", _one_hop("SELECT DISTINCT id FROM (SELECT start_id AS id FROM e UNION ALL SELECT end_id FROM e)"))
def _(spark, d):
    return tables.order_graph(spark, d).traverse(*_PLACED).nodes.select("id")


@query("g_traverse_edges", _one_hop("SELECT id, start_id, end_id FROM e"))
def _(spark, d):
    return tables.order_graph(spark, d).traverse(*_PLACED).edges.select("id", "start_id", "end_id")


@query("g_hydrated_nodes", "SELECT c_custkey * 16 + 3 AS id, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return tables.order_graph(spark, d).traverse(Start(where=BUILDING)).nodes.select("id", "c_name", "c_acctbal")


def _filter(name: str, start: Start, condition: str, table: str = "customer", key: str = "c_custkey * 16 + 3") -> None:
    @query(f"g_filter_{name}", f"SELECT {key} AS id FROM {table} WHERE {condition}")
    def _(spark, d):
        return tables.order_graph(spark, d).traverse(start).nodes.select("id")


_filter("equality", Start(where=BUILDING), "c_mktsegment = 'BUILDING'")
_filter("in_list", Start(where={"type": "customer", "c_mktsegment": ["BUILDING", "MACHINERY"]}), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("empty_list", Start(where={"type": "customer", "c_mktsegment": []}), "false")
_filter("and", Start(where=AND({"type": "customer"}, GT("c_acctbal", 5000), {"c_nationkey": 3})), "c_acctbal > 5000 AND c_nationkey = 3")
_filter("or", Start(where=AND({"type": "customer"}, OR(LT("c_acctbal", 0), {"c_mktsegment": "BUILDING"}))), "c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
_filter("not", Start(where=AND({"type": "customer"}, NOT({"c_mktsegment": "BUILDING"}))), "c_mktsegment <> 'BUILDING'")
_filter("gte_lte", Start(where=AND({"type": "customer"}, GTE("c_nationkey", 5), LTE("c_nationkey", 9))), "c_nationkey >= 5 AND c_nationkey <= 9")
_filter("between", Start(where=AND({"type": "part"}, BETWEEN("p_size", 10, 20))), "p_size BETWEEN 10 AND 20", "part", "p_partkey * 16 + 5")
_filter("callable", Start(where=AND({"type": "part"}, lambda a: F.length(a.text("p_name")) > 8)), "length(p_name) > 8", "part", "p_partkey * 16 + 5")
_filter("ids", Start(where={"type": "customer"}, ids=[19, 35, 51, "67", 4]), "c_custkey IN (1, 2, 3, 4)")
_filter("has_key", Start(where=AND(HasKey("c_name"), GT("c_acctbal", 9000))), "c_acctbal > 9000")


@query("g_filter_not_missing_key", "SELECT s_suppkey * 16 + 4 AS id FROM supplier UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 16 + 2 FROM nation")
def _(spark, d):
    g = tables.order_graph(spark, d)
    return g.traverse(Start(where=AND({"type": ["supplier", "nation"]}, NOT({"c_mktsegment": "BUILDING"})))).nodes.select("id")


@query("g_via_filter", f"WITH {EDGES} SELECT id, s AS start_id, t AS end_id FROM edges WHERE kind = 'contains' AND q > 45")
def _(spark, d):
    return tables.order_graph(spark, d).traverse(Start(where={"type": "order"}), Hop(via=AND({"kind": "contains"}, GT("l_quantity", 45)))).edges.select("id", "start_id", "end_id")


@query("g_backward", f"WITH {EDGES} SELECT DISTINCT id FROM (SELECT s AS id, t FROM edges WHERE kind = 'in_nation' AND t = 3 * 16 + 2 UNION ALL SELECT t, t FROM edges WHERE kind = 'in_nation' AND t = 3 * 16 + 2)")
def _(spark, d):
    return tables.order_graph(spark, d).traverse(Start(where={"type": "nation", "n_nationkey": 3}), Hop(via="in_nation", direction="backward")).nodes.select("id")


_CHAIN = (Start(where={"type": "customer", "c_mktsegment": "MACHINERY"}), Hop(via="placed", where={"o_orderstatus": "F"}), Hop(via="contains", where=AND({"type": "part"}, LTE("p_size", 10))), Hop(via="supplied_by"))
_CHAIN_SQL = """WITH h1 AS (SELECT o_orderkey * 16 + 4 AS id, c_custkey * 16 + 3 AS s, o_orderkey * 16 + 6 AS t, o_orderkey AS o
  FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'F'),
h2 AS (SELECT DISTINCT ((l_orderkey * 8 + l_linenumber) * 16777216 + l_partkey) * 16 + 5 AS id, l_orderkey * 16 + 6 AS s, l_partkey * 16 + 5 AS t, l_partkey AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN h1 ON l_orderkey = o WHERE p_size <= 10),
h3 AS (SELECT DISTINCT (l_partkey * 16777216 + l_suppkey) * 16 + 6 AS id, l_partkey * 16 + 5 AS s, l_suppkey * 16 + 4 AS t
  FROM lineitem JOIN (SELECT DISTINCT p FROM h2) ON l_partkey = p),
r AS (SELECT id, s, t FROM h1 UNION ALL SELECT id, s, t FROM h2 UNION ALL SELECT id, s, t FROM h3)"""


@query("g_chain_edges", _CHAIN_SQL + " SELECT id, s AS start_id, t AS end_id FROM r")
def _(spark, d):
    return tables.order_graph(spark, d).traverse(*_CHAIN).edges.select("id", "start_id", "end_id")


@query("g_chain_nodes", _CHAIN_SQL + " SELECT DISTINCT id FROM (SELECT s AS id FROM r UNION ALL SELECT t FROM r)")
def _(spark, d):
    return tables.order_graph(spark, d).traverse(*_CHAIN).nodes.select("id")


@query("g_optional_hop", """WITH e AS (SELECT c_custkey * 16 + 3 AS s, o_orderkey * 16 + 6 AS t FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE c_nationkey = 7 AND o_totalprice > 400000)
SELECT DISTINCT id FROM (SELECT c_custkey * 16 + 3 AS id FROM customer WHERE c_nationkey = 7 UNION ALL SELECT t FROM e)""")
def _(spark, d):
    g = tables.order_graph(spark, d)
    return g.traverse(Start(where={"type": "customer", "c_nationkey": 7}), Hop(via="placed", where=GT("o_totalprice", 400000), optional=True)).nodes.select("id")


def _recursive(edges: str, seed: str, low: int, high: int, match: str, out: str) -> str:
    return f"""WITH RECURSIVE {edges}, w AS (
  SELECT a.id AS a, e.t, 1 AS d, [a.id, e.t] AS p, [e.id] AS es FROM ({seed}) a JOIN edges e ON e.s = a.id
  UNION ALL
  SELECT w.a, e.t, w.d + 1, list_append(w.p, e.t), list_append(w.es, e.id) FROM w JOIN edges e ON e.s = w.t
  WHERE w.d < {high} AND NOT list_contains(w.p, e.t)
), landed AS (SELECT * FROM w WHERE d >= {low} AND t IN ({match})) {out}"""


_ALL_SEED, _ALL = "SELECT c_custkey * 16 + 3 AS id FROM customer", Start(where={"type": "customer"})


@query("g_walk_range_edges", _recursive(EDGES, _ALL_SEED, 1, 3, "SELECT p_partkey * 16 + 5 FROM part", "SELECT DISTINCT unnest(es) AS id FROM landed"))
def _(spark, d):
    return tables.order_graph(spark, d).traverse(_ALL, Hop(hops=(1, 3), where={"type": "part"})).edges.select("id")


@query("g_walk_exact", _recursive(EDGES, _ALL_SEED, 4, 4, "SELECT CAST(n_nationkey AS BIGINT) * 16 + 2 FROM nation UNION ALL SELECT s_suppkey * 16 + 4 FROM supplier", "SELECT DISTINCT unnest(es) AS id FROM landed"))
def _(spark, d):
    return tables.order_graph(spark, d).traverse(_ALL, Hop(hops=4, where={"type": ["nation", "supplier"]})).edges.select("id")


_RING = """edges AS (SELECT c_custkey * 16 + step + 6 AS id, c_custkey AS s, ((c_custkey + step - 1) % n + n) % n + 1 AS t
  FROM customer, (SELECT max(c_custkey) AS n FROM customer), (SELECT unnest([1, 7, -6]) AS step))"""
_RING_SEED, _RING_START = "SELECT c_custkey AS id FROM customer", Start(where=lambda a: a.raw("c_nationkey").isNotNull())


@query("g_walk_cycles_edges", _recursive(_RING, _RING_SEED, 2, 4, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT DISTINCT unnest(es) AS id FROM landed"))
def _(spark, d):
    return tables.ring_graph(spark, d).traverse(_RING_START, Hop(hops=(2, 4), where={"c_mktsegment": "BUILDING"})).edges.select("id")


@query("g_walk_cycles_count", _recursive(_RING, _RING_SEED, 1, 5, "SELECT c_custkey FROM customer", "SELECT count(DISTINCT t) AS n FROM landed"))
def _(spark, d):
    return tables.ring_graph(spark, d).aggregate(_RING_START, Hop(hops=(1, 5)), aggregates={"n": Count()})


@query("g_walk_all_edges", f"""WITH {EDGES}, big AS (SELECT * FROM edges WHERE q > 30 AND kind = 'contains')
SELECT id, s AS start_id, t AS end_id FROM big WHERE s IN (SELECT o_orderkey * 16 + 6 FROM orders)""")
def _(spark, d):
    return tables.order_graph(spark, d).cypher("MATCH p = (o:order)-[:contains*1..2]->(x:part) WHERE all(r IN relationships(p) WHERE r.l_quantity > 30) RETURN x").edges.select("id", "start_id", "end_id")


_AGG = {"n": Count(), "named": Count("o_orderpriority"), "priorities": Count("o_orderpriority", distinct=True), "total": Sum("o_totalprice"), "mean": Avg("o_totalprice"), "low": Min("o_totalprice"), "high": Max("o_totalprice")}
_AGG_SQL = """count(*) AS n, count(o_orderpriority) AS named, count(DISTINCT o_orderpriority) AS priorities, round(coalesce(sum(o_totalprice), 0), 2) AS total,
  round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("g_aggregate", f"SELECT {_AGG_SQL} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return _rounded(tables.order_graph(spark, d).aggregate(Start(where=BUILDING), Hop(via="placed"), aggregates=_AGG))


@query("g_aggregate_empty", f"SELECT {_AGG_SQL} FROM orders WHERE false")
def _(spark, d):
    return _rounded(tables.order_graph(spark, d).aggregate(Start(where={"type": "nobody"}), Hop(via="placed"), aggregates=_AGG))


@query("g_group_by", f"SELECT o_orderstatus, {_AGG_SQL} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderstatus")
def _(spark, d):
    return _rounded(tables.order_graph(spark, d).aggregate(Start(where=BUILDING), Hop(via="placed"), aggregates=_AGG, group_by="o_orderstatus"))


@query("g_group_by_missing", "SELECT c_mktsegment, count(*) AS n FROM (SELECT c_mktsegment FROM customer UNION ALL SELECT NULL FROM supplier) GROUP BY 1")
def _(spark, d):
    return tables.order_graph(spark, d).aggregate(Start(where={"type": ["customer", "supplier"]}), aggregates={"n": Count()}, group_by="c_mktsegment")


@query("g_sum_distinct", "SELECT sum(DISTINCT p_size)::DOUBLE AS total, round(avg(DISTINCT p_size), 6) AS mean FROM part")
def _(spark, d):
    out = tables.order_graph(spark, d).aggregate(Start(where={"type": "part"}), aggregates={"total": Sum("p_size", distinct=True), "mean": Avg("p_size", distinct=True)})
    return out.withColumn("mean", F.round("mean", 6))


@query("g_aggregate_deep", f"WITH {EDGES} SELECT count(DISTINCT e3.t) AS n FROM edges e1 JOIN edges e2 ON e2.s = e1.t AND e2.kind = 'contains' JOIN edges e3 ON e3.s = e2.t AND e3.kind = 'supplied_by' JOIN customer ON e1.s = c_custkey * 16 + 3 WHERE e1.kind = 'placed' AND c_nationkey = 3")
def _(spark, d):
    return tables.order_graph(spark, d).aggregate(Start(where={"type": "customer", "c_nationkey": 3}), Hop(via="placed"), Hop(via="contains"), Hop(via="supplied_by"), aggregates={"n": Count()})


# bags

_BAG = "(SELECT event_id * 16 + 8 AS id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"


@query("g_bag_filter", f"SELECT id FROM {_BAG} WHERE event_type = 'click' AND k > 50")
def _(spark, d):
    return tables.event_bags(spark, d).traverse(Start(where=AND({"type": "event", "event_type": "click"}, GT("k", 50)))).nodes.select("id")


@query("g_bag_aggregate", f"SELECT event_type, count(*) AS n, coalesce(sum(k), 0)::DOUBLE AS total, round(avg(value), 6) AS mean FROM {_BAG} GROUP BY event_type")
def _(spark, d):
    g = tables.event_bags(spark, d)
    return g.aggregate(Start(where={"type": "event"}), aggregates={"n": Count(), "total": Sum("k"), "mean": Avg("value")}, group_by="event_type").withColumn("mean", F.round("mean", 6))


@query("g_bag_traverse", "SELECT event_id * 16 + 7 AS id FROM events WHERE event_type = 'view'")
def _(spark, d):
    return tables.event_bags(spark, d).traverse(Start(where={"type": "user"}), Hop(via="performed", where={"event_type": "view"})).edges.select("id")


# vectors; the query vector is fixed

_Q = [((i * 37) % 11 - 5) / 7 for i in range(64)]
_QSQL = "[" + ", ".join(map(repr, _Q)) + "]::DOUBLE[]"
_SIM = f"list_cosine_similarity(embedding::DOUBLE[], {_QSQL})"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("similarity", 6).alias("similarity"))


@query("g_vector_search", f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 10")
def _(spark, d):
    return _hits(tables.vector_graph(spark, d).vector_search(Near("emb", _Q), k=10))


@query("g_vector_filtered", f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings WHERE label = 3 ORDER BY {_SIM} DESC, vec_id LIMIT 5")
def _(spark, d):
    return _hits(tables.vector_graph(spark, d).vector_search(Near("emb", _Q), k=5, where={"label": 3}))


@query("g_vector_floor", f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings WHERE {_SIM} >= 0.1")
def _(spark, d):
    return _hits(tables.vector_graph(spark, d).vector_search(Near("emb", _Q, min_similarity=0.1), k=None))


@query("g_vector_boost", f"""WITH c AS (SELECT vec_id, {_SIM} AS sim, label FROM embeddings WHERE {_SIM} >= 0),
b AS (SELECT vec_id, sim + 0.5 * (label - min(label) OVER ()) / (max(label) OVER () - min(label) OVER ()) AS s FROM c)
SELECT vec_id AS id, round(s, 6) AS similarity FROM b ORDER BY s DESC, vec_id LIMIT 10""")
def _(spark, d):
    return _hits(tables.vector_graph(spark, d).vector_search(Near("emb", _Q, min_similarity=0.0), k=10, boost=Boost("label", 0.5)))


@query("g_vector_many", f"""WITH q AS (SELECT 0 AS query, {_QSQL} AS q UNION ALL SELECT 1, list_transform({_QSQL}, lambda x: -x)),
s AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS sim FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS r FROM s)
SELECT query, vec_id AS id, round(sim, 6) AS similarity FROM r WHERE r <= 5""")
def _(spark, d):
    out = tables.vector_graph(spark, d).vector_search_many([Near("emb", _Q), Near("emb", [-x for x in _Q])], k=5)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("g_vector_seed_walk", f"""WITH s AS (SELECT vec_id FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 5)
SELECT vec_id * 4 + step AS id FROM s, (SELECT unnest([1, 2]) AS step), (SELECT max(vec_id) AS last FROM embeddings) WHERE vec_id + step <= last""")
def _(spark, d):
    return tables.vector_graph(spark, d).traverse(Start(near=Near("emb", _Q), keep=5), Hop()).edges.select("id")


@query("g_vector_node_beam", f"""WITH e AS (SELECT vec_id * 4 + step AS id, vec_id AS s, vec_id + step AS t FROM embeddings, (SELECT unnest([1, 2]) AS step) WHERE label = 1),
m AS (SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT t FROM e) ORDER BY {_SIM} DESC, vec_id LIMIT 7)
SELECT id FROM e WHERE t IN (SELECT vec_id FROM m)""")
def _(spark, d):
    return tables.vector_graph(spark, d).traverse(Start(where={"label": 1}), Hop(near=Near("emb", _Q), keep=7)).edges.select("id")


@query("g_vector_edge_beam", f"""WITH e AS (SELECT vec_id * 4 + step AS id, vec_id AS s, {_SIM} AS sim FROM embeddings, (SELECT unnest([1, 2]) AS step), (SELECT max(vec_id) AS last FROM embeddings)
  WHERE label = 1 AND vec_id + step <= last), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, id) AS r FROM e)
SELECT id FROM r WHERE r <= 1""")
def _(spark, d):
    return tables.vector_graph(spark, d).traverse(Start(where={"label": 1}), Hop(via_near=Near("emb", _Q), via_keep=1)).edges.select("id")


@query("g_vector_scores", f"""WITH c AS (SELECT vec_id, {_SIM} AS sim, label FROM embeddings)
SELECT vec_id AS id, round(sim + 0.01 * label, 6) AS similarity, round(sim, 6) AS emb, round(0.01 * label, 6) AS boost FROM c ORDER BY sim + 0.01 * label DESC, vec_id LIMIT 20""")
def _(spark, d):
    hits = tables.vector_graph(spark, d).vector_search(Near("emb", _Q), k=20, boost=Boost("label", 0.01, scale="raw"))
    return hits.select("id", F.round("similarity", 6).alias("similarity"), F.round(F.col("similarities")["emb"], 6).alias("emb"), F.round(F.col("boosts")["label"], 6).alias("boost"))


def _two_fields(spark, d):
    """Embeddings with a second field, the first half of each vector turned round; every third one lacks it."""
    g = vectors.define_vectors(tables.vector_graph(spark, d), nodes=[vectors.Vector("emb", 64), vectors.Vector("half", 32, embed=_embed)], migrate=True)
    half = F.when(F.col("id") % 3 != 0, F.transform(F.slice("vec_emb", 1, 32), lambda x: -x))
    return vectors.set_vectors(g, nodes=g.nodes.select("id", half.alias("half"))).graph


def _embed(texts):
    return [[float(len(t) + i % 5) for i in range(32)] for t in texts]


_TURNED = "list_transform(embedding[1:32]::DOUBLE[], lambda x: -x)"
_TEXT = "[" + ", ".join(map(str, _embed(["a query"])[0])) + "]::DOUBLE[]"


@query("g_vector_fields", f"""WITH c AS (SELECT vec_id, {_SIM} + 0.5 * CASE WHEN vec_id % 3 <> 0 THEN list_cosine_similarity({_TURNED}, {_TEXT}) ELSE 0 END AS s FROM embeddings)
SELECT vec_id AS id, round(s, 6) AS similarity FROM c ORDER BY s DESC, vec_id LIMIT 25""")
def _(spark, d):
    return _hits(_two_fields(spark, d).vector_search(Near("emb", _Q), Near("half", text="a query", weight=0.5, missing="zero"), k=25))


@query("g_set_vectors", f"SELECT vec_id AS id, round(list_cosine_similarity({_TURNED}, {_TEXT}), 6) AS similarity FROM embeddings WHERE vec_id % 3 <> 0")
def _(spark, d):
    return _hits(_two_fields(spark, d).vector_search(Near("half", text="a query", min_similarity=-1.0), k=None))


@query("g_drop_vectors", "SELECT vec_id AS id, 'missing' AS problem FROM embeddings")
def _(spark, d):
    return vectors.drop_vectors(_two_fields(spark, d), "half").stale_vectors("half", 32)


@query("g_load_vectors", "SELECT 'emb' AS name, 64 AS dimensions UNION ALL SELECT 'half', 32")
def _(spark, d):
    g = vectors.load_vectors(dataclasses.replace(_two_fields(spark, d), vectors={}))
    return spark.createDataFrame([(v.name, v.dimensions) for v in g.vectors["nodes"].values()], "name string, dimensions int")


# a reranker that only counts, so that SQL can follow it


def _lengths(question, documents):
    return [float(len(x)) for x in documents]


@query("g_rerank_filter", f"""WITH c AS (SELECT vec_id, label, {_SIM} AS sim FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 40)
SELECT vec_id AS id, length('vector ' || vec_id || ' of ' || label)::DOUBLE AS rerank_score FROM c ORDER BY 2 DESC, CAST(vec_id AS VARCHAR) LIMIT 10""")
def _(spark, d):
    r = Rerank(_lengths, "q", '"vector \\(.id) of \\(.properties.label)"', candidates=40, fields=("id", "properties.label"))
    return tables.vector_graph(spark, d).vector_search(Near("emb", _Q), k=10, rerank=r).select("id", "rerank_score")


@query("g_rerank_paths", """WITH e AS (SELECT vec_id AS s, vec_id + step AS t FROM embeddings, (SELECT unnest([1, 2]) AS step) WHERE label = 1 AND vec_id + step <= (SELECT max(vec_id) FROM embeddings)),
c AS (SELECT DISTINCT t FROM e ORDER BY t LIMIT 30), p AS (SELECT t, length(string_agg(CAST(s AS VARCHAR), ' ')) AS n FROM e WHERE t IN (SELECT t FROM c) GROUP BY t),
m AS (SELECT t FROM p ORDER BY n DESC, CAST(t AS VARCHAR) LIMIT 6)
SELECT s * 4 + t - s AS id FROM e WHERE t IN (SELECT t FROM m)""")
def _(spark, d):
    r = Rerank(_lengths, "q", '[.paths[] | .[0].id] | join(" ")', candidates=30)
    return tables.vector_graph(spark, d).traverse(Start(where={"label": 1}), Hop(keep=6, rerank=r)).edges.select("id")


# writes give new graphs


@query("g_delete_detach", f"""WITH {EDGES}, gone AS (SELECT c_custkey * 16 + 3 AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT kind, count(*) AS n FROM edges WHERE s NOT IN (SELECT id FROM gone) AND t NOT IN (SELECT id FROM gone) GROUP BY kind""")
def _(spark, d):
    g = mutate.delete_nodes(tables.order_graph(spark, d), BUILDING, detach=True).graph
    return g.edges.groupBy("kind").agg(F.count("*").alias("n"))


@query("g_update", "SELECT CASE WHEN c_acctbal > 9000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    g = mutate.update_nodes(tables.order_graph(spark, d), AND({"type": "customer"}, GT("c_acctbal", 9000)), set={"c_mktsegment": "RICH"}).graph
    return g.aggregate(Start(where={"type": "customer"}), aggregates={"n": Count()}, group_by="c_mktsegment")


@query("g_bag_update", f"SELECT id, 'seen' AS mark, NULL::VARCHAR AS value, event_type FROM {_BAG} WHERE k > 90")
def _(spark, d):
    g = mutate.update_nodes(tables.event_bags(spark, d), GT("k", 90), set={"mark": "seen"}, remove=["value"]).graph
    a = g.node_access
    return g.matching({"mark": "seen"}).select("id", a.text("mark").alias("mark"), a.text("value").alias("value"), a.text("event_type").alias("event_type"))


@query("g_merge", """SELECT n_name, n_regionkey + (CASE WHEN n_name IN (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3) THEN 100 ELSE 0 END) AS n_regionkey FROM nation
UNION ALL SELECT 'ATLANTIS', 7""")
def _(spark, d):
    g = constraints.define(tables.order_graph(spark, d), [constraints.Unique("n_name")])
    first = tables.read(spark, d, "nation").orderBy("n_nationkey").limit(3).select("n_name", F.lit("nation").alias("type"), (F.col("n_regionkey") + 100).alias("n_regionkey"))
    new = first.unionByName(spark.createDataFrame([("ATLANTIS", "nation", 7)], first.schema))
    g = mutate.merge_nodes(g, new, ["n_name"]).graph
    return g.matching({"type": "nation"}).select("n_name", "n_regionkey")


@query("g_merge_edges", """WITH old AS (SELECT o_orderkey * 16 + 4 AS id, o_custkey * 16 + 3 AS s, o_orderkey * 16 + 6 AS t FROM orders),
new AS (SELECT o_custkey * 16 + 3 AS s, o_orderkey * 16 + 6 AS t, o_totalprice AS weight FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT c_custkey * 16 + 3, CAST(c_nationkey AS BIGINT) * 16 + 2, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'),
j AS (SELECT coalesce(old.s, new.s) AS s, coalesce(old.t, new.t) AS t, weight FROM old FULL JOIN new ON old.s = new.s AND old.t = new.t)
SELECT s AS start_id, t AS end_id, weight FROM j""")
def _(spark, d):
    g = tables.order_graph(spark, d)
    g = dataclasses.replace(g, edges_table=g.matching_edges("placed"))
    keys = [constraints.Col("start_id"), constraints.Col("end_id")]
    g = constraints.define(g, [constraints.Unique(*keys, target="edges")])
    o, c = tables.read(spark, d, "orders"), tables.read(spark, d, "customer")
    new = o.where("o_orderstatus = 'F'").select(tables.node_id("o_custkey", tables.CUSTOMER).alias("start_id"), tables.node_id("o_orderkey", tables.ORDER).alias("end_id"), F.lit("placed").alias("kind"), F.col("o_totalprice").alias("weight"))
    new = new.union(c.where("c_mktsegment = 'BUILDING'").select(tables.node_id("c_custkey", tables.CUSTOMER), tables.node_id("c_nationkey", tables.NATION), F.lit("likes"), "c_acctbal"))
    return mutate.merge_edges(g, new, keys).graph.edges.select("start_id", "end_id", "weight")


@query("g_cypher_merge", """SELECT CAST(n_nationkey AS BIGINT) * 16 + 2 AS start_id, CAST(n_regionkey AS BIGINT) * 16 + 1 AS end_id, 'in_region' AS kind,
  CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN 'again' END AS mark FROM nation
UNION ALL SELECT CAST((SELECT n_nationkey FROM nation ORDER BY n_name LIMIT 1) AS BIGINT) * 16 + 2, CAST((SELECT n_nationkey FROM nation ORDER BY n_name DESC LIMIT 1) AS BIGINT) * 16 + 2, 'trades', 'new'""")
def _(spark, d):
    n = tables.read(spark, d, "nation")
    first, last = n.orderBy("n_name").first(), n.orderBy(F.desc("n_name")).first()
    g = tables.order_graph(spark, d)
    g = dataclasses.replace(g, edges_table=g.matching_edges("in_region"))
    match = f"MATCH (a:nation {{n_name: '{first['n_name']}'}}) MATCH (a)-[:in_region]->(b:region {{r_regionkey: {first['n_regionkey']}}})"
    g = g.cypher(f"{match} MERGE (a)-[r:in_region]->(b) ON CREATE SET r.mark = 'new' ON MATCH SET r.mark = 'again'").graph
    g = g.cypher(f"MERGE (a:nation {{n_name: '{first['n_name']}'}}) MERGE (b:nation {{n_name: '{last['n_name']}'}}) MERGE (a)-[r:trades]->(b) ON CREATE SET r.mark = 'new'").graph
    return g.edges.select("start_id", "end_id", "kind", "mark")


@query("g_enforced_schema", "SELECT c_custkey * 16 + 3 AS id FROM customer WHERE c_acctbal >= 0")
def _(spark, d):
    g = tables.order_graph(spark, d)
    g = dataclasses.replace(g, nodes_table=g.matching(AND({"type": "customer"}, GTE("c_acctbal", 0))), edges_table=g.edges_table.limit(0))
    s = schema.GraphSchema((schema.NodeType("customer", (schema.Property("c_name", required=True, unique=True), schema.Property("c_acctbal", ("number",), required=True))),))
    g = schema.enforce_schema(g, s)
    try:
        mutate.add_nodes(g, [{"id": 1, "type": "customer", "c_acctbal": 5.0}])
    except ConstraintViolation:
        return g.nodes.select("id")
    return g.nodes.select("id").limit(0)


@query("g_registry", "SELECT 'orders' AS name, 'of customers' AS description, 'sales' AS owner")
def _(spark, d):
    r = registry.Registry(spark, lineage.temporary(spark, "registry"))
    r.create_graph("orders", "first", owner="nobody")
    r.create_graph("orders", "of customers", owner="sales")
    return spark.createDataFrame([r.graph_info("orders")]).select("name", "description", "owner")


@query("g_csv", "SELECT c_custkey AS id, c_name, o_orderkey AS order_id FROM customer JOIN orders ON o_custkey = c_custkey")
def _(spark, d):
    path = lineage.temporary(spark, "csv")
    tables.read(spark, d, "customer").select("c_custkey", "c_name").write.csv(f"{path}/nodes", header=True)
    tables.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderkey").toDF("id", "start_id", "end_id").write.csv(f"{path}/edges", header=True)
    n, e = registry.from_csv(spark, f"{path}/nodes", f"{path}/edges", "id bigint, c_name string", "id bigint, start_id bigint, end_id bigint")
    found = PropertyGraph.create(n, e, acyclic=True)
    return found.edges.join(found.nodes.withColumnRenamed("id", "start_id"), "start_id").select(F.col("start_id").alias("id"), "c_name", F.col("id").alias("order_id"))


@query("g_violations_required", "SELECT s_suppkey * 16 + 4 AS id FROM supplier UNION ALL SELECT p_partkey * 16 + 5 FROM part")
def _(spark, d):
    return constraints.Required("c_name", where={"type": ["customer", "supplier", "part"]}).violations(tables.order_graph(spark, d))


@query("g_violations_type", f"SELECT id FROM {_BAG} WHERE k IS NOT NULL")
def _(spark, d):
    return constraints.PropertyType("k", "string", where={"type": "event"}).violations(tables.event_bags(spark, d))


@query("g_violations_unique", "SELECT c_custkey * 16 + 3 AS id FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)")
def _(spark, d):
    return constraints.Unique("c_nationkey").violations(tables.order_graph(spark, d))


@query("g_violations_check", "SELECT c_custkey * 16 + 3 AS id FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    return constraints.Check(GTE("c_acctbal", 0), "solvent", where={"type": "customer"}).violations(tables.order_graph(spark, d))


@query("g_infer_counts", """SELECT 'event' AS type, key, json_type, n, (SELECT count(*) FROM events) AS total FROM (
  SELECT 'type' AS key, 'string' AS json_type, count(*) AS n FROM events UNION ALL SELECT 'event_type', 'string', count(event_type) FROM events
  UNION ALL SELECT 'value', 'number', count(value) FROM events UNION ALL SELECT 'k', 'number', count(CAST(props->>'$.k' AS INTEGER)) FROM events) WHERE n > 0
UNION ALL SELECT 'user', key, json_type, (SELECT count(DISTINCT user_id) FROM events), (SELECT count(DISTINCT user_id) FROM events)
FROM (VALUES ('type', 'string'), ('user_id', 'number')) AS t(key, json_type)""")
def _(spark, d):
    g = tables.event_bags(spark, d)
    return schema.property_counts(g.nodes, g.node_access, "type")


@query("g_endpoint_counts", f"""WITH {EDGES} SELECT kind, CASE kind WHEN 'in_region' THEN 'nation' WHEN 'in_nation' THEN CASE s % 16 WHEN 3 THEN 'customer' ELSE 'supplier' END
  WHEN 'placed' THEN 'customer' WHEN 'contains' THEN 'order' WHEN 'supplied_by' THEN 'part' ELSE 'user' END AS source,
  CASE kind WHEN 'in_region' THEN 'region' WHEN 'in_nation' THEN 'nation' WHEN 'placed' THEN 'order' WHEN 'contains' THEN 'part' WHEN 'supplied_by' THEN 'supplier' ELSE 'event' END AS target,
  count(*) AS n FROM edges GROUP BY 1, 2, 3""")
def _(spark, d):
    return schema.endpoint_counts(tables.order_graph(spark, d))


# the other languages


@query("g_cypher", _one_hop("SELECT id, start_id, end_id FROM e"))
def _(spark, d):
    found = tables.order_graph(spark, d).cypher("MATCH (c:customer {c_mktsegment: 'BUILDING'})-[:placed]->(o:order) WHERE o.o_orderstatus = 'F' RETURN o")
    return found.edges.select("id", "start_id", "end_id")


@query("g_cypher_aggregate", "SELECT o_orderstatus, count(DISTINCT o_orderkey) AS n, max(o_totalprice) AS high FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY 1")
def _(spark, d):
    return tables.order_graph(spark, d).cypher("MATCH (c:customer)-[:placed]->(o:order) WHERE c.c_acctbal > 5000 RETURN o.o_orderstatus, count(DISTINCT o) AS n, max(o.o_totalprice) AS high")


@query("g_json", _one_hop("SELECT count(DISTINCT end_id) AS n FROM e"))
def _(spark, d):
    spec = {"start": {"where": {"type": "customer", "c_mktsegment": "BUILDING"}}, "hops": [{"via": "placed", "where": {"o_orderstatus": "F"}}], "aggregates": {"n": {"fn": "count"}}}
    return tables.order_graph(spark, d).aggregate_json(spec)


@query("g_export", "SELECT id FROM (SELECT CAST(r_regionkey AS BIGINT) * 16 + 1 AS id FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 16 + 2 FROM nation UNION ALL SELECT c_custkey * 16 + 3 FROM customer UNION ALL SELECT s_suppkey * 16 + 4 FROM supplier UNION ALL SELECT p_partkey * 16 + 5 FROM part UNION ALL SELECT o_orderkey * 16 + 6 FROM orders UNION ALL SELECT DISTINCT user_id * 16 + 7 FROM events UNION ALL SELECT event_id * 16 + 8 FROM events) ORDER BY id LIMIT 100")
def _(spark, d):
    return tables.order_graph(spark, d).export(100).nodes.select("id")


@query("g_export_edges", f"""WITH {EDGES}, few AS (SELECT CAST(n_nationkey AS BIGINT) * 16 + 2 AS id FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 16 + 1 FROM region UNION ALL SELECT c_custkey * 16 + 3 FROM customer),
n AS (SELECT id FROM few ORDER BY id LIMIT 200) SELECT e.id, s AS start_id, t AS end_id FROM edges e WHERE s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)""")
def _(spark, d):
    g = tables.order_graph(spark, d)
    return dataclasses.replace(g, nodes_table=g.matching({"type": ["region", "nation", "customer"]})).export(200).edges.select("id", "start_id", "end_id")


@query("g_json_vectors", f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings WHERE label = 2 ORDER BY {_SIM} DESC, vec_id LIMIT 7")
def _(spark, d):
    spec = {"near": {"field": "emb", "vector": _Q}, "k": 7, "where": {"label": 2}}
    return _hits(json_spec.vector_search(tables.vector_graph(spark, d), spec))
