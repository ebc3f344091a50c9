"""What properties the nodes and edges of each type have: inferred from the rows, or declared and checked."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.props import JSON_TYPES, json_type
from graphloom.operators import constraints, lineage

_JSON_SCHEMA = {"string": "string", "number": "number", "boolean": "boolean", "object": "object", "array": "array", "null": "null"}


@dataclass(frozen=True)
class Property:
    name: str
    json_types: tuple[str, ...] = ("string",)
    required: bool = False
    unique: bool = False
    values: tuple | None = None

    def __post_init__(self):
        bad = set(self.json_types) - set(JSON_TYPES)
        if bad or not self.json_types:
            raise GraphError(f"{self.name}: JSON types are {JSON_TYPES}")


@dataclass(frozen=True)
class NodeType:
    name: str
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class EdgeType:
    name: str
    source: str
    target: str
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class GraphSchema:
    nodes: tuple[NodeType, ...] = ()
    edges: tuple[EdgeType, ...] = field(default=())

    def __post_init__(self):
        names = [n.name for n in self.nodes]
        triples = [(e.name, e.source, e.target) for e in self.edges]
        if len(set(names)) < len(names) or len(set(triples)) < len(triples):
            raise GraphError("a type is declared twice")
        lost = {x for e in self.edges for x in (e.source, e.target)} - set(names)
        if lost:
            raise GraphError(f"edges end in undeclared types: {sorted(lost)}")
        for name in {e.name for e in self.edges}:
            if len({e.properties for e in self.edges if e.name == name}) > 1:
                raise GraphError(f"edges of kind {name!r} are declared with different properties")

    def rules(self) -> list[constraints.Rule]:
        """The rules that rows of declared types keep."""
        out: list[constraints.Rule] = []
        groups = [(n, {"type": n.name}, "nodes") for n in self.nodes]
        groups += [(e, {"kind": e.name}, "edges") for e in {e.name: e for e in self.edges}.values()]
        for kind, where, target in groups:
            for p in kind.properties:
                if p.required:
                    out.append(constraints.Required(p.name, where=where, target=target))
                allowed = p.json_types
                out.append(constraints.Check(lambda a, p=p, allowed=allowed: F.coalesce(a.json_type(p.name).isin(list(allowed)), F.lit(True)), f"{kind.name}.{p.name} type", where, target))
                if p.values is not None:
                    out.append(constraints.Check(lambda a, p=p: a.text(p.name).isNull() | a.text(p.name).isin([str(v) for v in p.values]), f"{kind.name}.{p.name} values", where, target))
                if p.unique:
                    out.append(constraints.Unique(p.name, where=where, target=target))
        return out

    def json_schema(self) -> dict:
        """As JSON Schema, one definition for each type."""

        def one(kind) -> dict:
            props = {p.name: {"type": [_JSON_SCHEMA[t] for t in p.json_types]} | ({"enum": list(p.values)} if p.values else {}) for p in kind.properties}
            return {"type": "object", "properties": props, "required": [p.name for p in kind.properties if p.required]}

        return {"nodes": {n.name: one(n) for n in self.nodes}, "edges": {f"{e.source}-{e.name}-{e.target}": one(e) for e in self.edges}}

    def mermaid(self) -> str:
        """As a Mermaid class diagram."""
        lines = ["classDiagram"]
        for n in self.nodes:
            lines += [f"  class {n.name} {{", *(f"    {'|'.join(p.json_types)} {p.name}" for p in n.properties), "  }"]
        return "\n".join([*lines, *(f"  {e.source} --> {e.target} : {e.name}" for e in self.edges)])

    def networkx(self):
        """As a networkx graph of types."""
        import networkx

        out = networkx.MultiDiGraph()
        for n in self.nodes:
            out.add_node(n.name, properties={p.name: list(p.json_types) for p in n.properties})
        for e in self.edges:
            out.add_edge(e.source, e.target, key=e.name, properties={p.name: list(p.json_types) for p in e.properties})
        return out

    def prompt(self, most: int = 12) -> str:
        """As text for a language model: a line for each type, with ``most`` of its properties."""

        def listed(props: tuple[Property, ...]) -> str:
            shown = [f"{p.name}: {'|'.join(p.json_types)}{'' if p.required else '?'}" for p in props[:most]]
            return "{" + ", ".join([*shown, *([f"{len(props) - most} more"] if len(props) > most else [])]) + "}"

        return "\n".join([*(f"({n.name} {listed(n.properties)})" for n in self.nodes), *(f"({e.source})-[{e.name} {listed(e.properties)}]->({e.target})" for e in self.edges)])

    def document(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_document(cls, text: str) -> GraphSchema:
        """A schema that was saved; a document of another form is refused."""
        try:
            d = json.loads(text)
            if set(d) != {"nodes", "edges"} or any(set(n) != {"name", "properties"} for n in d["nodes"]) or any(set(e) != {"name", "source", "target", "properties"} for e in d["edges"]):
                raise GraphError("a schema has nodes of name and properties, and edges of name, source, target and properties")
            if not all(isinstance(x, str) and x for n in [*d["nodes"], *d["edges"]] for k, x in n.items() if k != "properties"):
                raise GraphError("names are texts")
            return cls._of(d)
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            raise GraphError(f"this isn't a schema: {e}") from e

    @classmethod
    def _of(cls, d: dict) -> GraphSchema:
        props = lambda x: tuple(Property(p["name"], tuple(p["json_types"]), p["required"], p["unique"], tuple(p["values"]) if p["values"] else None) for p in x)
        return cls(tuple(NodeType(n["name"], props(n["properties"])) for n in d["nodes"]), tuple(EdgeType(e["name"], e["source"], e["target"], props(e["properties"])) for e in d["edges"]))


class Endpoints(constraints.Rule):
    """Edges of a declared kind run between types that it is declared for."""

    target, where = "edges", None

    def __init__(self, schema: GraphSchema):
        self.schema = schema

    def __repr__(self):
        return "Endpoints"

    def violations(self, g) -> DataFrame:
        return endpoint_violations(g, self.schema)


def define_schema(g, schema: GraphSchema | None):
    """``g`` with a schema on record; nothing is checked."""
    return dataclasses.replace(g, schema=schema)


def schema_rules(schema: GraphSchema, endpoints: bool = False) -> list[constraints.Rule]:
    """What ``enforce_schema`` would declare."""
    out = [*schema.rules(), *([Endpoints(schema)] if endpoints else [])]
    for r in out:
        r.of_schema = True
    return out


def enforce_schema(g, schema: GraphSchema | None = None, endpoints: bool = False):
    """``g`` with the rules of its schema, or of one given, checked on its rows and on every write from now on.

    Rules of a schema that was enforced before go; those declared otherwise stay. Refused if rows break a rule.
    """
    schema = schema or g.schema
    if schema is None:
        raise GraphError("there is no schema to enforce")
    own = [r for r in g.rules if not getattr(r, "of_schema", False)]
    out = constraints.define(dataclasses.replace(g, rules=own), schema_rules(schema, endpoints))
    return dataclasses.replace(out, schema=schema)


def property_counts(rows: DataFrame, access, discriminator: str) -> DataFrame:
    """(type, key, json_type, n, total): in how many of the type's rows a key has a value of a type; one pass and one shuffle."""
    kind = access.text(discriminator)
    if "properties" in rows.columns:
        each = rows.select(kind.alias("type"), F.explode(F.map_entries(F.col("properties").cast("map<string,variant>"))).alias("e"))
        pairs = each.select("type", F.col("e.key").alias("key"), json_type(F.col("e.value")).alias("json_type"))
    else:
        cells = F.array(*(F.struct(F.lit(k).alias("key"), access.json_type(k).alias("json_type")) for k in access.keys()))
        pairs = rows.select(kind.alias("type"), F.explode(cells).alias("c")).select("type", "c.key", "c.json_type").where("json_type is not null")
    counts = pairs.where("type is not null").groupBy("type", "key", "json_type").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.select(kind.alias("type")).where("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, "type").select("type", "key", "json_type", "n", "total")


def endpoint_counts(g) -> DataFrame:
    """(kind, source, target, n): which types each kind of edge connects."""
    types = g.nodes.select("id", g.node_access.text("type").alias("t"))
    e = g.edges.select("start_id", "end_id", g.edge_access.text("kind").alias("kind"))
    parts = max(lineage.parts(e), lineage.parts(types))

    # spread by the size of what is read: merged by their compressed size, partitions take many more rows
    def typed(rows: DataFrame, end: str, name: str) -> DataFrame:
        of = types.select(F.col("id").alias(end), F.col("t").alias(name)).repartition(parts, end)
        return rows.repartition(parts, end).join(of, end)

    joined = typed(typed(e, "start_id", "source"), "end_id", "target")
    return joined.groupBy("kind", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def infer(g, sample_percent: float | None = None) -> GraphSchema:
    """A schema from the rows: a property is required where every row of its type has it."""
    nodes, edges = g.nodes, g.edges
    if sample_percent is not None:
        nodes, edges = nodes.sample(sample_percent / 100, seed=1), edges.sample(sample_percent / 100, seed=1)

    def types(rows: DataFrame, access, discriminator: str) -> dict[str, tuple[Property, ...]]:
        found: dict[str, dict[str, list]] = {}
        for r in property_counts(rows, access, discriminator).collect():
            found.setdefault(r["type"], {}).setdefault(r["key"], []).append((r["json_type"], r["n"], r["total"]))
        return {t: tuple(Property(k, tuple(sorted(x[0] for x in v)), sum(x[1] for x in v) == v[0][2]) for k, v in sorted(keys.items()) if k != discriminator) for t, keys in found.items()}

    kinds = types(edges, g.edge_access, "kind")
    triples = [r for r in endpoint_counts(g).collect() if None not in (r["kind"], r["source"], r["target"])]
    node_types = types(nodes, g.node_access, "type")
    return GraphSchema(tuple(NodeType(t, node_types[t]) for t in sorted(node_types)), tuple(EdgeType(r["kind"], r["source"], r["target"], kinds.get(r["kind"], ())) for r in sorted(triples)))


def endpoint_violations(g, schema: GraphSchema) -> DataFrame:
    """Edges of a declared kind between types that it isn't declared for."""
    declared: Sequence = [(e.name, e.source, e.target) for e in schema.edges]
    types = g.nodes.select("id", g.node_access.text("type").alias("t"))
    e = g.edges.select("id", "start_id", "end_id", g.edge_access.text("kind").alias("kind")).where(F.col("kind").isin([d[0] for d in declared]))
    e = e.join(types.select(F.col("id").alias("start_id"), F.col("t").alias("source")), "start_id").join(types.select(F.col("id").alias("end_id"), F.col("t").alias("target")), "end_id")
    allowed = F.lit(False)
    for k, s, t in declared:
        allowed = allowed | ((F.col("kind") == k) & (F.col("source") == s) & (F.col("target") == t))
    return e.where(F.col("source").isNull() | F.col("target").isNull() | ~allowed).select("id")
