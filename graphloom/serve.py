"""Graphs as tools: a table of plain functions over JSON, allowed by what a caller may do, and a small HTTP server on top."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from graphloom.errors import GraphError
from graphloom.functions.filters import parse_filter
from graphloom.graph import PropertyGraph, _plain
from graphloom.operators import mutate, schema, vectors
from graphloom.plans import cypher, json_spec

_FILTER = {"type": "object", "description": "properties, or and, or, not, gt, gte, lt, lte, between"}
_RERANK = {"type": "object", "properties": {"document_from": {"type": "string"}, "candidates": {"type": "integer"}}, "additionalProperties": False}
_START = {"type": "object", "properties": {"search": {"type": "string"}, "rerank": _RERANK, "where": _FILTER, "ids": {"type": "array", "items": {"type": ["integer", "string"]}}, "near": {"type": ["object", "array"]}, "keep": {"type": "integer"}}, "additionalProperties": False}
_HOP = {"type": "object", "properties": {"where": _FILTER, "via": {"type": ["string", "object"]}, "hops": {"type": ["integer", "array"]}, "direction": {"enum": ["forward", "backward"]}, "optional": {"type": "boolean"}, "near": {"type": ["object", "array"]}, "keep": {"type": "integer"}, "via_near": {"type": ["object", "array"]}, "via_keep": {"type": "integer"}}, "additionalProperties": False}
_WALK = {"start": _START, "hops": {"type": "array", "items": _HOP}}
_AGGREGATE = {"type": "object", "properties": {"fn": {"enum": ["count", "sum", "avg", "min", "max"]}, "property": {"type": "string"}, "distinct": {"type": "boolean"}}, "required": ["fn"], "additionalProperties": False}


def _object(properties: dict, *required: str) -> dict:
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}


#: Nodes that a search starts from, unless told otherwise.
SEARCH_KEEP = 25

#: By tool: what its caller must be allowed to do, and its arguments as JSON Schema.
TOOLS: dict[str, tuple[str, dict]] = {
    "list_graphs": ("read", _object({})),
    "describe_graph": ("read", _object({})),
    "traverse": ("read", _object(_WALK, "start")),
    "aggregate": ("read", _object(_WALK | {"aggregates": {"type": "object", "additionalProperties": _AGGREGATE}, "group_by": {"type": "string"}}, "start", "aggregates")),
    "search": ("read", _object({"near": {"type": ["object", "array"]}, "target": {"enum": ["nodes", "edges"]}, "k": {"type": ["integer", "null"]}, "where": _FILTER, "boost": {"type": ["object", "array"]}}, "near")),
    "cypher": ("read", _object({"query": {"type": "string"}}, "query")),
    "infer_schema": ("read", _object({})),
    "define_schema": ("write", _object({"schema": {"type": "object"}}, "schema")),
    "enforce_schema": ("mutate", _object({"endpoints": {"type": "boolean"}})),
    "repoint_edge": ("mutate", _object({"id": {"type": "integer"}, "start_id": {"type": "integer"}, "end_id": {"type": "integer"}}, "id")),
    "set_vectors": ("write", _object({"nodes": {"type": "array"}, "edges": {"type": "array"}})),
    "graph_data": ("read", _object({"limit": {"type": "integer"}})),
    "ingest": ("write", _object({"nodes": {"type": "array"}, "edges": {"type": "array"}, "merge_nodes_on": {"type": "array"}, "merge_edges_on": {"type": "array"}})),
    "mutate": ("mutate", _object({"operations": {"type": "array", "items": {"type": "object"}}}, "operations")),
    "delete_nodes": ("mutate", _object({"where": _FILTER, "detach": {"type": "boolean"}})),
}


class Server:
    """Tools over named graphs. Writes replace the named graph by the new one, one at a time; with several graphs ``graph`` must be named.

    ``search`` is the vector field that {"start": {"search": text}} looks in; ``rerank`` the policy for reranking, without which there is
    none; ``vectors`` says whether callers may give vectors of their own.
    """

    def __init__(self, graphs: dict[str, PropertyGraph], allow: tuple[str, ...] = ("read",), max_nodes: int = 500, search: str | None = None, rerank=None, vectors: bool = False):
        self.graphs, self.allow, self.max_nodes = dict(graphs), set(allow), max_nodes
        self.search, self.rerank, self.vectors, self.writing = search, rerank, vectors, threading.RLock()

    def tools(self) -> dict[str, dict]:
        """The schemas of the tools that are allowed."""
        named = {"graph": {"enum": sorted(self.graphs)}}
        out = {}
        for name, (need, spec) in TOOLS.items():
            if need in self.allow:
                required = spec["required"] + (["graph"] if len(self.graphs) > 1 and name != "list_graphs" else [])
                out[name] = {**spec, "properties": {**spec["properties"], **(named if name != "list_graphs" else {})}, "required": required}
        return out

    def call(self, tool: str, args: dict) -> object:
        known = self.tools()
        if tool not in known:
            raise GraphError(f"there is no tool {tool!r} here")
        if extra := set(args) - set(known[tool]["properties"]):
            raise GraphError(f"{tool} has no {sorted(extra)}")
        if missing := set(known[tool]["required"]) - set(args):
            raise GraphError(f"{tool} needs {sorted(missing)}")
        args = dict(args)
        name = args.pop("graph", next(iter(self.graphs)))
        if name not in self.graphs:
            raise GraphError(f"there is no graph {name!r}")
        run = getattr(self, f"_{tool}")
        if TOOLS[tool][0] == "read" and tool != "cypher":
            return run(name, self.graphs[name], args)
        with self.writing:  # what a write starts from is what the one before it left
            return run(name, self.graphs[name], args)

    def _seeded(self, spec: dict) -> dict:
        """A traversal whose start may have a text to search for."""
        start = spec.get("start")
        if not isinstance(start, dict) or "search" not in start:
            return spec
        if self.search is None:
            raise GraphError("there is no field to search here")
        if "near" in start:
            raise GraphError("a start has search or near, not both")
        rest = {k: v for k, v in start.items() if k != "search"}
        return {**spec, "start": {"keep": SEARCH_KEEP, **rest, "near": {"field": self.search, "text": start["search"]}}}

    def _subgraph(self, found) -> dict:
        # a result that is too large is refused, never cut
        if found.nodes.limit(self.max_nodes + 1).count() > self.max_nodes:
            raise GraphError(f"more than {self.max_nodes} nodes; narrow the question")
        return found.collect()

    def _rows(self, df) -> dict:
        rows = df.limit(self.max_nodes + 1).collect()
        if len(rows) > self.max_nodes:
            raise GraphError(f"more than {self.max_nodes} rows; narrow the question")
        return {"rows": [{k: v.toPython() if hasattr(v, "toPython") else _plain(v) for k, v in r.asDict().items()} for r in rows]}

    def _list_graphs(self, name, g, args) -> dict:
        return {"graphs": sorted(self.graphs)}

    def _describe_graph(self, name, g, args) -> dict:
        return (g.schema or schema.infer(g)).json_schema()

    def _traverse(self, name, g, args) -> dict:
        return self._subgraph(g.traverse_json(self._seeded(args), self.rerank, self.vectors))

    def _aggregate(self, name, g, args) -> dict:
        return self._rows(g.aggregate_json(self._seeded(args), self.rerank, self.vectors))

    def _search(self, name, g, args) -> dict:
        return self._rows(json_spec.vector_search(g, args, self.rerank, self.vectors))

    def _graph_data(self, name, g, args) -> dict:
        limit = args.get("limit", self.max_nodes)
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= self.max_nodes:
            raise GraphError(f"limit is a number from 1 to {self.max_nodes}")
        return g.export(limit).collect()

    def _infer_schema(self, name, g, args) -> dict:
        return json.loads(schema.infer(g).document())

    def _define_schema(self, name, g, args) -> dict:
        self.graphs[name] = schema.define_schema(g, schema.GraphSchema.from_document(json.dumps(args["schema"])))
        return self.graphs[name].schema.json_schema()

    def _enforce_schema(self, name, g, args) -> dict:
        self.graphs[name] = schema.enforce_schema(g, endpoints=args.get("endpoints", False))
        return {"rules": [str(r) for r in self.graphs[name].rules]}

    def _repoint_edge(self, name, g, args) -> dict:
        return self._done(name, mutate.repoint_edge(g, args["id"], args.get("start_id"), args.get("end_id")))

    def _set_vectors(self, name, g, args) -> dict:
        if not self.vectors and any(not isinstance(v, str | None) for rows in args.values() for r in rows for k, v in r.items() if k != "id"):
            raise GraphError("give texts; vectors aren't taken here")
        return self._done(name, vectors.set_vectors(g, args.get("nodes", ()), args.get("edges", ())))

    def _cypher(self, name, g, args) -> dict:
        what = cypher.classify(cypher.parse(args["query"]))
        need = {"aggregate": "read"}.get(what, what)
        if need not in self.allow:
            raise GraphError(f"this query would {need}, which isn't allowed here")
        out = g.cypher(args["query"])
        if what == "read":
            return self._subgraph(out)
        return self._rows(out) if what == "aggregate" else self._done(name, out)

    def _done(self, name, change) -> dict:
        self.graphs[name] = change.graph
        return {"nodes": change.nodes, "edges": change.edges}

    def _ingest(self, name, g, args) -> dict:
        merge = {k: args.pop(k, None) for k in ("merge_nodes_on", "merge_edges_on")}
        return self._done(name, mutate.ingest(g, args, **merge))

    def _mutate(self, name, g, args) -> dict:
        return self._done(name, mutate.mutate(g, args))

    def _delete_nodes(self, name, g, args) -> dict:
        return self._done(name, mutate.delete_nodes(g, parse_filter(args.get("where")), detach=args.get("detach", False)))

    def http(self, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        """POST /<tool> with a JSON object, GET /health, /tools, /graphs and /schema; call ``serve_forever`` on what comes back."""
        tools = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, status: int, body: object) -> None:
                data = json.dumps(body, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self):
                known = {"/health": lambda: {"status": "ok"}, "/tools": tools.tools, "/graphs": lambda: tools.call("list_graphs", {})}
                if len(tools.graphs) == 1:
                    known["/schema"] = lambda: tools.call("describe_graph", {})
                self._run(known[self.path]) if self.path in known else self._answer(404, {"error": "no such path"})

            def _run(self, what) -> None:
                try:
                    self._answer(200, what())
                except (GraphError, ValueError) as e:
                    self._answer(400, {"error": str(e)})
                except Exception:  # a query that Spark couldn't run: its text may name files and rows
                    self._answer(500, {"error": "the query failed"})

            def do_POST(self):
                body = self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"
                tool = {"edges/repoint": "repoint_edge"}.get(self.path.strip("/"), self.path.strip("/"))

                def answer() -> object:
                    args = json.loads(body)
                    if not isinstance(args, dict):
                        raise GraphError("send a JSON object")
                    return tools.call(tool, args)

                self._run(answer)

            def log_message(self, *_):
                pass

        return ThreadingHTTPServer((host, port), Handler)
