"""The property graph: a handle on two DataFrames, and the questions asked of it."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import GraphError
from graphloom.functions import filters
from graphloom.functions.props import BagAccess, TypedAccess
from graphloom.operators import lineage, similarity, walk
from graphloom.operators.aggregates import Count
from graphloom.plans.specs import Boost, Hop, Near, Start, check_chain

NODE_COLUMNS = ("id", "graph_id")
EDGE_COLUMNS = ("id", "graph_id", "start_id", "end_id")


def _plain(value: object) -> object:
    """Whole numbers without a fraction, variants as Python values."""
    if isinstance(value, T.VariantVal) if hasattr(T, "VariantVal") else False:
        return value.toPython()
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value.asDict(True) if hasattr(value, "asDict") else value


@dataclass
class Subgraph:
    """What a traversal found, as two lazy DataFrames with all columns of the graph's tables."""

    nodes: DataFrame
    edges: DataFrame
    elapsed_ms: float | None = None

    def collect(self) -> dict:
        """Rows as dictionaries, ids as strings."""
        began = time.time()
        out = {"nodes": [_render(r, NODE_COLUMNS) for r in self.nodes.collect()], "edges": [_render(r, EDGE_COLUMNS) for r in self.edges.collect()]}
        self.elapsed_ms = out["elapsed_ms"] = (time.time() - began) * 1000
        return out

    to_dict = collect

    def to_networkx(self, multigraph: bool = False):
        """As a networkx graph, if that library is there; without ``multigraph`` parallel edges collapse."""
        try:
            import networkx
        except ImportError as e:
            raise ImportError("to_networkx needs networkx") from e
        g = networkx.MultiDiGraph() if multigraph else networkx.DiGraph()
        found = self.collect()
        for n in found["nodes"]:
            g.add_node(n["id"], **n["properties"])
        for e in found["edges"]:
            g.add_edge(e["start_id"], e["end_id"], **e["properties"], **({"key": e["id"]} if multigraph else {}))
        return g


def _render(row, reserved: Sequence[str]) -> dict:
    d = row.asDict()
    out = {k: str(d.pop(k)) for k in reserved if k in d and k != "graph_id"}
    d.pop("graph_id", None)
    if "properties" in d:
        p = d.pop("properties")
        out["properties"] = p.toPython() if hasattr(p, "toPython") else p
        return out | {k: v for k, v in d.items() if not k.startswith("vec_")}
    return out | {"properties": {k: _plain(v) for k, v in d.items() if v is not None and not k.startswith("vec_")}}


@dataclass
class PropertyGraph:
    """Nodes (id, ...) and edges (id, start_id, end_id, ...) with properties in a VARIANT column or in columns of their own.

    ``graph_col`` tells graphs in the same tables apart; every read is then scoped to ``name``. ``acyclic`` says of edges,
    or of edges of certain kinds, that they have no cycle, which spares looking; None looks at the ids. It isn't checked: where
    it is wrong, a walk reports edges that only lead around a circle as well.
    """

    nodes_table: DataFrame
    edges_table: DataFrame
    name: str = "default"
    graph_col: str | None = None
    acyclic: bool | None = None
    rules: list = field(default_factory=list)
    schema: object = None
    #: Declared vector fields by target and name; see ``operators.vectors``.
    vectors: dict = field(default_factory=dict)

    @classmethod
    def create(cls, nodes: DataFrame, edges: DataFrame, name: str = "default", *, node_id: str = "id", edge_id: str = "id", start: str = "start_id", end: str = "end_id", graph_col: str | None = None, acyclic: bool | None = None) -> PropertyGraph:
        """A graph over tables whose columns have other names."""
        for table, columns in ((nodes, (node_id, graph_col)), (edges, (edge_id, start, end, graph_col))):
            missing = [c for c in columns if c and c not in table.columns]
            if missing:
                raise GraphError(f"no such column: {', '.join(missing)}")
        n = nodes.withColumnRenamed(node_id, "id")
        e = edges.withColumnsRenamed({edge_id: "id", start: "start_id", end: "end_id"})
        if graph_col:
            n, e = n.withColumnRenamed(graph_col, "graph_id"), e.withColumnRenamed(graph_col, "graph_id")
        return cls(n, e, name, "graph_id" if graph_col else None, acyclic)

    @property
    def spark(self) -> SparkSession:
        return self.nodes_table.sparkSession

    def _scope(self, t: DataFrame) -> DataFrame:
        return t.where(F.col(self.graph_col) == self.name) if self.graph_col else t

    @property
    def nodes(self) -> DataFrame:
        return self._scope(self.nodes_table)

    @property
    def edges(self) -> DataFrame:
        return self._scope(self.edges_table)

    def in_graph(self, name: str) -> PropertyGraph:
        """Another graph in the same tables."""
        if not self.graph_col:
            raise GraphError("these tables hold a single graph")
        return PropertyGraph(self.nodes_table, self.edges_table, name, self.graph_col, self.acyclic, vectors=self.vectors)

    def graphs(self) -> list[str]:
        """Names of the graphs that have nodes."""
        if not self.graph_col:
            return [self.name]
        return [r[0] for r in self.nodes_table.select(self.graph_col).distinct().orderBy(self.graph_col).collect()]

    @property
    def node_access(self) -> filters.Access:
        return BagAccess() if "properties" in self.nodes_table.columns else TypedAccess(self.nodes_table, NODE_COLUMNS)

    @property
    def edge_access(self) -> filters.Access:
        return BagAccess() if "properties" in self.edges_table.columns else TypedAccess(self.edges_table, EDGE_COLUMNS)

    def matching(self, where: object = None, ids: Sequence[int] | None = None) -> DataFrame:
        """Nodes that pass a filter and, if given, have one of the ids."""
        out = self.nodes.where(filters.compile_filter(where, self.node_access)) if where not in (None, {}) else self.nodes
        return out if ids is None else out.where(F.col("id").isin(list(ids)) if ids else F.lit(False))

    def matching_edges(self, via: object = None, ids: Sequence[int] | None = None) -> DataFrame:
        out = self.edges.where(filters.compile_via(via, self.edge_access)) if via not in (None, {}) else self.edges
        return out if ids is None else out.where(F.col("id").isin(list(ids)) if ids else F.lit(False))

    # traversal

    def _with_vectors(self, near: Sequence[Near], target: str = "nodes") -> tuple[Near, ...]:
        """Conditions given by a text, with the vector that the field's embedder makes of it."""
        fields = self.vectors.get(target, {})
        for n in near:
            if n.text is not None and n.field not in fields:
                raise GraphError(f"{n.field!r} isn't a declared vector field: a text needs its embedder")
        return tuple(n if n.text is None else n.of(fields[n.field].of_text([n.text])[0]) for n in near)

    def _ranked(self, rows: DataFrame, near, keep, boost) -> DataFrame:
        return similarity.best(similarity.scored(rows, self._with_vectors(near), self.node_access, boost), keep).select("id")

    def _seed(self, start: Start) -> DataFrame:
        rows = self.matching(start.where, start.ids)
        if start.rerank is not None:
            from graphloom.operators import rerank

            return rerank.step(self, rows, start)
        return self._ranked(rows, start.near, start.keep, start.boost) if start.near else rows.select("id")

    def _hop(self, anchors: DataFrame, hop: Hop, want_edges: bool = True) -> walk.Walked:
        a, b = ("start_id", "end_id") if hop.direction == "forward" else ("end_id", "start_id")
        rows = self.matching_edges(hop.via)
        # the ends go by one name each while edges are shuffled
        edges = rows.withColumnsRenamed({a: "from_id", b: "to_id"})
        targets = self.matching(hop.where).select("id") if hop.where not in (None, {}) else None
        if hop.via_near:
            walked = self._edge_beam(anchors, edges, targets, hop)
        else:
            beam = bool(hop.near) or hop.rerank is not None
            walked = walk.walk(anchors, edges, targets, hop.low, hop.high, self.acyclic, want_edges or beam)
        if hop.near or hop.rerank is not None:
            walked = self._node_beam(anchors, edges, walked, hop)
        own = [F.col({a: "from_id", b: "to_id"}.get(c, c)).alias(c) for c in rows.columns]
        return dataclasses.replace(walked, edges=walked.edges.select(*own, "from_id", "to_id"))

    def _node_beam(self, anchors: DataFrame, edges: DataFrame, walked: walk.Walked, hop: Hop) -> walk.Walked:
        """Only the best of the reached nodes count, and only edges that lead to them."""
        reached = self.nodes.join(walked.match, "id", "left_semi")
        if hop.rerank is not None:
            from graphloom.operators import rerank

            ways = (lambda few: walked.walks) if walked.walks is not None else (lambda few: walk.enumerated(anchors, edges, few, hop.low, hop.high).walks)
            kept = rerank.step(self, reached, hop, ways)
        else:
            kept = self._ranked(reached, hop.near, hop.keep, hop.boost)
        if walked.walks is not None:
            landed = walked.walks.join(kept.select(F.col("id").alias("to_id")), "to_id", "left_semi")
            taken = landed.select(F.explode("edge_ids").alias("id")).distinct()
            return walk.Walked(kept, walked.edges.join(taken, "id", "left_semi"), landed)
        return walk.Walked(kept, walk.walk(anchors, edges, kept, hop.low, hop.high, self.acyclic).edges)

    def _edge_beam(self, anchors: DataFrame, edges: DataFrame, targets: DataFrame | None, hop: Hop) -> walk.Walked:
        """Each walk goes on over its best edges only; those that would close a circle are no candidates."""
        scored = similarity.scored(edges, self._with_vectors(hop.via_near, "edges"), self.edge_access).select("id", F.col("from_id").alias("at"), F.col("to_id").alias("next"), "similarity")
        walks = []
        current = anchors.select(F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast("array<bigint>").alias("edge_ids")).distinct()
        for depth in range(hop.high):
            met = current.join(scored, "at")
            if depth:
                met = met.where(~F.array_contains("path", F.col("next")))
            # edge ids tell walks with the same nodes apart
            met = similarity.best(met, hop.via_keep, ["at", "path", "edge_ids"])
            current = met.select(F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"), F.array_append("edge_ids", F.col("id")).alias("edge_ids"))
            walks.append(current.withColumnRenamed("at", "to_id"))
        out = walks[hop.low - 1]
        for w in walks[hop.low :]:
            out = out.unionByName(w)
        if targets is not None:
            out = out.join(targets.select(F.col("id").alias("to_id")), "to_id", "left_semi")
        taken = out.select(F.explode("edge_ids").alias("id")).distinct()
        return walk.Walked(out.select(F.col("to_id").alias("id")).distinct(), edges.join(taken, "id", "left_semi"), out)

    def _chain(self, start: Start, hops: Sequence[Hop]) -> tuple[DataFrame, DataFrame]:
        """Ids of the nodes that a traversal reports, and its edges with all columns.

        Between hops the edges so far are written out, so that no hop is computed again for those after it.
        """
        check_chain(hops)
        match = self._seed(start)
        if not hops:
            return match.distinct(), self.edges.limit(0)
        reported: DataFrame | None = None
        for i, hop in enumerate(hops):
            before, walked = match, self._hop(match, hop)
            match, edges = walked.match, walked.edges
            if i < len(hops) - 1:
                edges = lineage.cut(edges)
                match = edges.select(F.col("to_id").alias("id")).distinct() if hop.high == 1 else lineage.cut(match)
            reported = edges if reported is None else reported.unionByName(edges)
        ids = reported.select(F.explode(F.array("from_id", "to_id")).alias("id"))
        if hops[-1].optional:
            ids = ids.union(before.select("id"))
        # an edge is reported once, however many hops took it
        return ids.distinct(), (reported.dropDuplicates(["id"]) if len(hops) > 1 else reported).drop("from_id", "to_id")

    def traverse(self, start: Start, *hops: Hop) -> Subgraph:
        """The subgraph of a chain of hops.

        A hop reports the edges of walks that end in its own matches; whether later hops go on from there doesn't matter.
        Nodes are the ends of reported edges, and with an optional last hop the nodes it started from.
        """
        if not hops and not start.near and start.rerank is None:
            return Subgraph(self.matching(start.where, start.ids), self.edges.limit(0))
        nodes, edges = self._chain(start, hops)
        # the ids are distinct; a semi-join would be pushed into every branch of the nodes' union, and the walk be run for each
        return Subgraph(self.nodes.join(nodes, "id"), edges)

    def build_query(self, start: Start, *hops: Hop) -> tuple[DataFrame, DataFrame]:
        """The plans of ``traverse``: the last hop isn't run, those before it are, as their edges are written out."""
        found = self.traverse(start, *hops)
        return found.nodes, found.edges

    def last_match(self, start: Start, *hops: Hop) -> DataFrame:
        """Ids of the nodes that the last hop matched."""
        match = self._seed(start)
        for i, hop in enumerate(hops):
            match = self._hop(match, hop, want_edges=False).match
            if i < len(hops) - 1:
                match = lineage.cut(match)
        return match.distinct()

    def aggregate(self, start: Start, *hops: Hop, aggregates: dict, group_by: str | None = None) -> DataFrame:
        """One row of aggregates over the last match, or one for each value of a property, nulls last."""
        if not aggregates:
            raise GraphError("aggregates can't be empty")
        if any(h.optional for h in hops):
            raise GraphError("an aggregate can't end in an optional hop")
        if group_by is not None and group_by in aggregates:
            raise GraphError(f"{group_by!r} can't be both the group and an aggregate")
        a = self.node_access
        columns = [agg.column(a).alias(name) for name, agg in aggregates.items()]
        if not hops and not start.near and start.rerank is None:
            rows = self.matching(start.where, start.ids)
        else:
            rows = self.last_match(start, *hops)
            if group_by is not None or any(agg != Count() for agg in aggregates.values()):
                rows = self.nodes.join(rows, "id")
        if group_by is None:
            return rows.agg(*columns)
        return rows.groupBy(a.text(group_by).alias(group_by)).agg(*columns).orderBy(F.asc_nulls_last(group_by))

    def count(self, start: Start, *hops: Hop) -> int:
        return self.aggregate(start, *hops, aggregates={"n": Count()}).first()["n"]

    # vectors

    def _target(self, target: str) -> tuple[DataFrame, filters.Access]:
        if target not in ("nodes", "edges"):
            raise GraphError("target is 'nodes' or 'edges'")
        return (self.nodes, self.node_access) if target == "nodes" else (self.edges, self.edge_access)

    def vector_search(self, *near: Near, target: str = "nodes", k: int | None = 10, where: object = None, boost: Sequence[Boost] | Boost = (), rerank=None) -> DataFrame:
        """The k best rows by weighted cosine, ties by id: all their columns but vectors, and how they scored."""
        boost = (boost,) if isinstance(boost, Boost) else tuple(boost)
        similarity.check_k(near, k)
        rows, access = self._target(target)
        near = self._with_vectors(near, target)
        rows = rows.where((filters.compile_filter if target == "nodes" else filters.compile_via)(where, access))
        if rerank is not None:
            from graphloom.operators import rerank as r

            return r.flat(similarity.best(similarity.scored(rows, near, access, boost), rerank.candidates), near, boost, rerank, k)
        hits = similarity.best(similarity.scored(rows, near, access, boost), k)
        own = [c for c in rows.columns if not c.startswith("vec_")]
        return hits.select(*own, *similarity.report(hits, near, boost))

    def vector_search_many(self, queries: Sequence[Sequence[Near] | Near], target: str = "nodes", k: int | None = 10, where: object = None) -> DataFrame:
        """(query, id, similarity) for a batch of queries of one shape."""
        rows, access = self._target(target)
        rows = rows.where((filters.compile_filter if target == "nodes" else filters.compile_via)(where, access))
        return similarity.many(rows, [self._with_vectors((q,) if isinstance(q, Near) else tuple(q), target) for q in queries], k, access)

    def get_vectors(self, ids: Sequence[int], *fields: str, target: str = "nodes") -> DataFrame:
        rows, _ = self._target(target)
        return rows.where(F.col("id").isin(list(ids))).select("id", *(f"vec_{f}" for f in fields))

    def stale_vectors(self, name: str, dimensions: int, target: str = "nodes", after: int | None = None, limit: int | None = None) -> DataFrame:
        """(id, problem): rows whose vector is missing or has another length, by id."""
        rows, _ = self._target(target)
        v: Column = F.col(f"vec_{name}")
        bad = rows.select("id", F.when(v.isNull(), "missing").when(F.size(v) != dimensions, "wrong_dimensions").alias("problem")).where("problem is not null")
        bad = (bad if after is None else bad.where(F.col("id") > after)).orderBy("id")
        return bad if limit is None else bad.limit(limit)

    # languages

    def cypher(self, query: str, **options):
        """Runs a query of the Cypher subset; see ``plans.cypher``."""
        from graphloom.plans import cypher

        return cypher.run(self, query, **options)

    def traverse_json(self, spec: dict, rerank=None, allow_vectors: bool = True) -> Subgraph:
        """``rerank`` is a policy; without one, a question can't ask for reranking."""
        from graphloom.plans import json_spec

        return self.traverse(*json_spec.traversal(spec, rerank, allow_vectors))

    def aggregate_json(self, spec: dict, rerank=None, allow_vectors: bool = True) -> DataFrame:
        from graphloom.plans import json_spec

        start, hops, aggregates, group_by = json_spec.aggregation(spec, rerank, allow_vectors)
        return self.aggregate(start, *hops, aggregates=aggregates, group_by=group_by)

    def export(self, limit: int = 2000) -> Subgraph:
        """Up to ``limit`` nodes, smallest ids first, and the edges between them."""
        ids = self.nodes.select("id").orderBy("id").limit(limit)
        nodes = self.nodes.join(ids, "id", "left_semi")
        inside = self.edges.join(ids.withColumnRenamed("id", "start_id"), "start_id", "left_semi").join(ids.withColumnRenamed("id", "end_id"), "end_id", "left_semi")
        return Subgraph(nodes, inside)
