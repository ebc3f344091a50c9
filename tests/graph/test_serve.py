import json
import threading
import urllib.error
import urllib.request

import pytest

from graphloom.errors import GraphError
from graphloom.graph import PropertyGraph
from graphloom.operators.embed import Embedder, embed_stale
from graphloom.plans.specs import Near
from graphloom.serve import Server
from graphloom.sources.networks import add_networkx


@pytest.fixture
def g(spark):
    nodes = spark.createDataFrame([(1, "a", "one"), (2, "a", "three"), (3, "b", " ")], "id long, type string, name string")
    edges = spark.createDataFrame([(1, 1, 2, "k"), (2, 2, 3, "k")], "id long, start_id long, end_id long, kind string")
    return PropertyGraph.create(nodes, edges)


def test_tools(g):
    s = Server({"g": g}, ("read", "write", "mutate"))
    assert {n["id"] for n in s.call("traverse", {"start": {"where": {"type": "a"}}, "hops": [{"via": "k"}]})["nodes"]} == {"1", "2", "3"}
    assert s.call("aggregate", {"start": {}, "aggregates": {"n": {"fn": "count"}}})["rows"] == [{"n": 3}]
    assert s.call("ingest", {"nodes": [{"type": "c"}], "edges": [{"start_id": 1, "end_id": {"type": "c"}, "kind": "k"}]}) == {"nodes": 1, "edges": 1}
    assert s.call("cypher", {"query": "MATCH (x:c) DETACH DELETE x"}) == {"nodes": 1, "edges": 1}
    assert s.call("aggregate", {"start": {}, "aggregates": {"n": {"fn": "count"}}})["rows"] == [{"n": 3}]
    reader = Server({"g": g, "h": g}, max_nodes=2)
    assert "mutate" not in reader.tools()
    for tool, args in (("mutate", {"operations": []}), ("traverse", {"start": {}}), ("traverse", {"graph": "g", "start": {}}), ("cypher", {"graph": "g", "query": "MATCH (x) DETACH DELETE x"})):
        with pytest.raises(GraphError):
            reader.call(tool, args)


def test_too_many_rows_are_refused(g):
    ask = {"start": {}, "aggregates": {"n": {"fn": "count"}}, "group_by": "name"}
    assert len(Server({"g": g}, max_nodes=3).call("aggregate", ask)["rows"]) == 3
    with pytest.raises(GraphError):
        Server({"g": g}, max_nodes=2).call("aggregate", ask)


def test_search_schema_and_ceilings(g):
    from graphloom.operators.vectors import Vector, define_vectors

    v = define_vectors(g, nodes=[Vector("n", 2, embed=lambda texts: [[float(len(t)), 1.0] for t in texts])], migrate=True)
    s = Server({"g": v}, ("read", "write", "mutate"), search="n")
    assert s.call("set_vectors", {"nodes": [{"id": 1, "n": "one"}, {"id": 2, "n": "three"}]}) == {"nodes": 2, "edges": 0}
    found = s.call("traverse", {"start": {"search": "thrice", "keep": 1}, "hops": [{"via": "k"}]})
    assert {n["id"] for n in found["nodes"]} == {"2", "3"}
    assert {n["id"] for n in s.call("traverse", {"start": {"search": "thrice"}})["nodes"]} == {"1", "2"}
    assert s.call("repoint_edge", {"id": 1, "end_id": 3}) == {"nodes": 0, "edges": 1}
    declared = s.call("infer_schema", {})
    assert {n["name"] for n in declared["nodes"]} == {"a", "b"}
    s.call("define_schema", {"schema": declared})
    assert s.call("enforce_schema", {})["rules"]
    for tool, args in (("graph_data", {"limit": 501}), ("search", {"near": {"field": "n", "vector": [1, 2]}}), ("set_vectors", {"nodes": [{"id": 1, "n": [1, 2]}]}), ("traverse", {"start": {"search": "x", "rerank": {}}}), ("ingest", {"nodes": [{"type": "a"}]})):
        with pytest.raises(GraphError):
            s.call(tool, args)


def test_http(g):
    server = Server({"g": g}).http()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    post = lambda p, b: json.loads(urllib.request.urlopen(urllib.request.Request(at + p, json.dumps(b).encode())).read())
    assert json.loads(urllib.request.urlopen(at + "/health").read()) == {"status": "ok"}
    assert len(post("/graph_data", {"limit": 2})["edges"]) == 1
    assert "a" in json.loads(urllib.request.urlopen(at + "/schema").read())["nodes"]
    with pytest.raises(urllib.error.HTTPError):
        post("/traverse", {"begin": {}})
    server.shutdown()


def test_embedding(g):
    out = embed_stale(g, "n", "name", Embedder(lambda texts: [[len(t), 1.0] for t in texts], 2, batch_size=1))
    assert {r["id"]: r["vec_n"] for r in out.nodes.collect()} == {1: [3.0, 1.0], 2: [5.0, 1.0], 3: None}
    assert [r["id"] for r in out.vector_search(Near("n", (1, 0)), k=1).collect()] == [2]


def test_clients_and_retries(g):
    from types import SimpleNamespace as N

    from graphloom.operators.embed import client_of, stale_counts

    assert stale_counts(g, "n", "name", 2) == (2, 1)
    one = lambda texts: [[float(len(t))] for t in texts]
    shapes = [one, N(encode=one), N(embed_documents=one, embed_query=lambda t: [9.0]), N(get_text_embedding_batch=one), N(embed=lambda texts, model: N(embeddings=one(texts)))]
    shapes.append(N(embeddings=N(create=lambda model, input: N(data=[N(index=i, embedding=v) for i, v in reversed([*enumerate(one(input))])]))))
    assert all([*map(list, client_of(c)(["a", "bb"]))] == [[1.0], [2.0]] for c in shapes)
    assert Embedder(shapes[2], 1)(["a"], query=True) == [[9.0]]
    with pytest.raises(GraphError):
        client_of(object())

    class Busy(Exception):
        def __init__(self, status):
            self.status_code, self.headers = status, {"Retry-After": "0"}

    for status, tries in ((429, 3), (503, 3), (400, 1)):
        calls = []

        def fail(texts):
            calls.append(texts)
            raise Busy(status)

        with pytest.raises(Busy):
            Embedder(fail, 1, retries=2)(["a"])
        assert len(calls) == tries


def test_network_rows(g):
    class Network:
        def nodes(self, data):
            return [(10, {"type": "n"}), (11, {})]

        def edges(self, data):
            return [(10, 11, {"kind": "k"}), (10, 1, {})]

    done = add_networkx(g, Network())
    assert (done.nodes, done.edges) == (2, 2)
