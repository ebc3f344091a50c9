"""Vector fields, merges, Cypher MERGE, schemas, the registry, the filter language and rerankers, on small graphs."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.errors import ConstraintViolation, GraphError
from graphloom.functions import projection
from graphloom.functions.projection import ProjectionError, compile_filter
from graphloom.graph import PropertyGraph
from graphloom.operators import constraints, lineage, mutate, rerank, schema, vectors
from graphloom.operators.constraints import Col, Unique
from graphloom.operators.vectors import Vector
from graphloom.plans.specs import Hop, Near, Start
from graphloom.sources import registry

TOWNS = [(1, "town", "Arden", 900), (2, "town", "Brill", 450), (3, "port", "Cove", 120), (4, "port", "Dunmore", None)]
ROADS = [(11, 1, 2, "road", 7), (12, 2, 3, "road", 4), (13, 1, 3, "rail", 9), (14, 3, 4, "ferry", 2)]


@pytest.fixture(params=["bag", "typed"])
def g(request, spark):
    nodes = spark.createDataFrame(TOWNS, "id long, type string, name string, people int")
    edges = spark.createDataFrame(ROADS, "id long, start_id long, end_id long, kind string, miles int")
    if request.param == "bag":
        nodes = nodes.select("id", F.parse_json(F.to_json(F.struct("type", "name", "people"))).alias("properties"))
        edges = edges.select("id", "start_id", "end_id", F.parse_json(F.to_json(F.struct("kind", "miles"))).alias("properties"))
    return PropertyGraph.create(nodes, edges)


def edge_rows(g):
    a = g.edge_access
    return {(r["s"], r["e"], r["k"], r["m"]) for r in g.edges.select(F.col("start_id").alias("s"), F.col("end_id").alias("e"), a.text("kind").alias("k"), a.text("miles").alias("m")).collect()}


def test_life_of_a_vector_field(g):
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    v = vectors.define_vectors(g, nodes=[Vector("place", 2, embed=embed)], edges=[Vector("way", 3)], migrate=True)
    assert "vec_place" in v.nodes_table.columns and "vec_way" in v.edges_table.columns
    done = vectors.set_vectors(v, nodes=[{"id": 1, "place": [3.0, 4.0]}, {"id": 2, "place": "abc"}, {"id": 3, "place": None}], edges=[{"id": 11, "way": [1, 0, 0]}])
    assert (done.nodes, done.edges) == (3, 1)
    full = done.graph
    assert {r["id"]: r["vec_place"] for r in full.nodes.collect()} == {1: [3.0, 4.0], 2: [3.0, 1.0], 3: None, 4: None}
    # a row without the field leaves it alone
    again = vectors.set_vectors(vectors.define_vectors(full, nodes=[Vector("other", 1)], migrate=True), nodes=[{"id": 1, "other": [5]}, {"id": 2, "place": None}]).graph
    assert {r["id"]: (r["vec_place"], r["vec_other"]) for r in again.nodes.where("id < 3").collect()} == {1: ([3.0, 4.0], [5.0]), 2: (None, None)}
    for bad in ([{"id": 1, "place": [1.0]}], [{"id": 1, "place": [1, 2]}, {"id": 1, "place": [1, 2]}], [{"id": 99, "place": [1, 2]}], [{"id": 1, "nothing": [1, 2]}], [{"place": [1, 2]}], [{"id": 1, "place": [float("nan"), 1]}]):
        with pytest.raises(GraphError):
            vectors.set_vectors(full, nodes=bad)
    with pytest.raises(GraphError):
        vectors.set_vectors(full, edges=[{"id": 11, "way": "no embedder"}])
    found = full.vector_search(Near("place", text="abc"), k=2).collect()
    assert [r["id"] for r in found] == [2, 1]
    assert {r["id"] for r in full.traverse(Start(near=Near("place", text="abc"), keep=1), Hop(via="road")).nodes.collect()} == {2, 3}
    with pytest.raises(GraphError):
        g.vector_search(Near("place", text="abc"))
    loaded = vectors.load_vectors(PropertyGraph(full.nodes_table, full.edges_table))
    assert {v.name: v.dimensions for v in loaded.vectors["nodes"].values()} == {"place": 2} and loaded.vectors["edges"]["way"].dimensions == 3
    empty = vectors.drop_vectors(full, "place")
    assert empty.stale_vectors("place", 2).count() == 4 and "place" in empty.vectors["nodes"]
    for bad in (lambda: Vector("Bad", 2), lambda: Vector("x" * 60, 2), lambda: Vector("x", 0), lambda: vectors.migrate_vectors(vectors.define_vectors(full, nodes=[Vector("place", 3)])), lambda: vectors.drop_vectors(full, "none")):
        with pytest.raises(GraphError):
            bad()
    for bad in ({"text": "[1, 2]"}, {"text": " "}, {}, {"query": [1.0], "text": "a"}):
        with pytest.raises(GraphError):
            Near("place", **bad)


def test_vectors_of_many_graphs(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, graph string")
    edges = spark.createDataFrame([], "id long, graph string, start_id long, end_id long")
    a = vectors.define_vectors(PropertyGraph.create(nodes, edges, "a", graph_col="graph"), nodes=[Vector("v", 1)], migrate=True)
    a = vectors.set_vectors(a, nodes=spark.createDataFrame([(1, [2.0])], "id long, v array<float>")).graph
    b = vectors.set_vectors(a.in_graph("b"), nodes=[{"id": 2, "v": [3.0]}]).graph
    with pytest.raises(GraphError):
        vectors.set_vectors(b, nodes=[{"id": 1, "v": [3.0]}])
    assert {r["id"]: r["vec_v"] for r in vectors.drop_vectors(b, "v").nodes_table.collect()} == {1: [2.0], 2: None}


def test_merge_edges(g):
    ends = [Col("start_id"), Col("end_id")]
    with pytest.raises(GraphError):
        mutate.merge_edges(g, [{"start_id": 1, "end_id": 2}], ends)
    u = constraints.define(g, [Unique(*ends, target="edges")])
    done = mutate.merge_edges(u, [{"start_id": 1, "end_id": {"name": "Brill"}, "miles": 8}, {"start_id": 4, "end_id": 1, "kind": "ferry", "miles": 30}], ends)
    assert done.edges == 2
    assert edge_rows(done.graph) == {(1, 2, "road", "8"), (2, 3, "road", "4"), (1, 3, "rail", "9"), (3, 4, "ferry", "2"), (4, 1, "ferry", "30")}
    other = mutate.merge_edges(u, [{"start_id": 1, "end_id": 2, "kind": "path"}], ends, replace=True).graph
    assert (1, 2, "path", None) in edge_rows(other) and len(edge_rows(other)) == 4
    with pytest.raises(GraphError):
        mutate.merge_edges(u, [{"start_id": 1, "end_id": 2}, {"start_id": 1, "end_id": 2}], ends)
    with pytest.raises(ConstraintViolation):
        mutate.merge_edges(u, [{"start_id": 1, "end_id": 77}], ends)
    by_id = constraints.define(g, [Unique(Col("id"))])
    out = mutate.ingest(by_id, {"nodes": [{"id": 1, "people": 901}, {"id": 9, "type": "town", "name": "Elm"}], "edges": [{"start_id": 9, "end_id": 1, "kind": "road"}]}, merge_nodes_on=["id"])
    assert (out.nodes, out.edges) == (2, 1) and out.graph.matching({"people": 901, "name": "Arden"}).count() == 1 and out.graph.nodes.count() == 5
    with pytest.raises(GraphError):
        Unique("start_id", target="edges")
    with pytest.raises(GraphError):
        Col("name")


def test_references_are_looked_up_together(g):
    done = mutate.add_edges(g, [{"start_id": {"name": "Arden"}, "end_id": {"name": "Cove"}, "kind": "air"}, {"start_id": {"name": "Arden"}, "end_id": 4, "kind": "air"}])
    assert {(s, e) for s, e, k, _ in edge_rows(done.graph) if k == "air"} == {(1, 3), (1, 4)}
    for bad in ({"name": "Nowhere"}, {"type": "town"}):
        with pytest.raises(GraphError):
            mutate.add_edges(g, [{"start_id": bad, "end_id": 1}])


def test_cypher_merges(g):
    match = "MATCH (a {name: 'Arden'}) MATCH (a)-[:road]->(b {name: 'Brill'}) "
    once = g.cypher(match + "MERGE (a)-[r:road]->(b) ON CREATE SET r.miles = 1 ON MATCH SET r.miles = 70").graph
    assert (1, 2, "road", "70") in edge_rows(once) and len(edge_rows(once)) == 4
    new = g.cypher("MERGE (a:town {name: 'Elm'}) ON CREATE SET a.people = 5 MERGE (b:port {name: 'Cove'}) ON MATCH SET b.people = null MERGE (a)<-[r:rail]-(b) ON CREATE SET r.miles = 3, r.kind = 'rail'").graph
    assert (3, 5, "rail", "3") in edge_rows(new) and new.matching({"name": "Elm", "people": 5}).count() == 1
    assert new.aggregate(Start(where={"name": "Cove"}), aggregates={"n": __import__("graphloom.operators.aggregates", fromlist=["Count"]).Count("people")}).first()["n"] == 0
    for bad in ("MERGE (a)-[:road]->(b)", "MERGE (a:town {name: 'x'}) ON CREATE SET b.people = 1", match + "MERGE (a)-[:road*1..2]->(b)"):
        with pytest.raises(GraphError):
            g.cypher(bad)


def test_cypher_paths_and_aggregates(g):
    found = g.cypher("MATCH p = (a {name: 'Arden'})-[*1..3]->(b:port) WHERE all(r IN relationships(p) WHERE r.miles < 9 AND r.kind = 'road') RETURN b")
    assert {r["id"] for r in found.edges.collect()} == {11, 12}
    # two ways lead to Cove: counting it for each is refused
    for bad in ("sum(b.people)", "count(b.people)", "avg(b.people)", "count(b)"):
        with pytest.raises(GraphError):
            g.cypher(f"MATCH (a:town)-[]->(b:port) RETURN {bad}")
    assert tuple(g.cypher("MATCH (a:town)-[]->(b:port) WITH DISTINCT b RETURN sum(b.people) AS s, count(b) AS n").first()) == (120, 1)
    assert g.cypher("MATCH (a:town)-[]->(b:port) RETURN max(b.people) AS m, count(DISTINCT b.people) AS n").first()["m"] == 120
    for bad in ("MATCH (a:town)-[]->(b) WITH DISTINCT a RETURN count(b) AS n", "MATCH (a) WHERE all(r IN relationships(p) WHERE r.x = 1) RETURN a", "MATCH p = (a)-[]->(b) WHERE all(r IN relationships(p) WHERE b.x = 1) RETURN b"):
        with pytest.raises(GraphError):
            g.cypher(bad)


def world():
    p = schema.Property
    town = (p("name", required=True), p("people", ("number", "null")))
    ways = [("road", "town", "town"), ("road", "town", "port"), ("rail", "town", "port"), ("ferry", "port", "port")]
    return schema.GraphSchema((schema.NodeType("town", town), schema.NodeType("port", town)), tuple(schema.EdgeType(*w, (p("miles", ("number",)),)) for w in ways))


def test_schemas(g):
    s = world()
    assert schema.define_schema(g, s).schema == s
    held = schema.enforce_schema(g, s, endpoints=True)
    with pytest.raises(ConstraintViolation):
        mutate.add_nodes(held, [{"type": "town", "people": 1}])
    with pytest.raises(ConstraintViolation):
        mutate.add_edges(held, [{"start_id": 4, "end_id": 1, "kind": "rail"}])
    assert mutate.add_edges(held, [{"start_id": 4, "end_id": 3, "kind": "ferry"}]).edges == 1
    # rules of the old schema go, others stay
    own = constraints.define(held, [Unique("name")])
    looser = schema.enforce_schema(own, schema.GraphSchema((schema.NodeType("town"), schema.NodeType("port"))))
    assert [str(r) for r in looser.rules] == ["Unique('name',)"]
    with pytest.raises(ConstraintViolation):
        schema.enforce_schema(g, schema.GraphSchema((schema.NodeType("port", (schema.Property("miles", required=True),)),)))
    assert "(town)-[rail {miles: number?}]->(port)" in s.prompt() and "1 more" in s.prompt(1)
    for bad in ("[]", "{}", '{"nodes": [{"name": "", "properties": []}], "edges": []}', "no"):
        with pytest.raises(GraphError):
            schema.GraphSchema.from_document(bad)
    ask = lambda q: g.cypher(q, schema=s, strict_schema=True)
    assert ask("MATCH (a:town)-[:rail]->(b:port) WHERE b.people > 1 RETURN b").edges.count() == 1
    for bad in ("MATCH (a:city) RETURN a", "MATCH (a:town)-[:canal]->(b) RETURN b", "MATCH (a:town {size: 1}) RETURN a", "MATCH (a:town) WHERE a.size > 1 RETURN a", "MATCH (a:port)-[:rail]->(b:town) RETURN b", "CREATE (a:town {size: 1})", "MATCH (a:town) SET a.size = 1", "MATCH (a:town) RETURN sum(a.size)", "MATCH (a:town)-[r:road]->(b) WHERE r.people = 1 RETURN b"):
        with pytest.raises(GraphError):
            ask(bad)


def test_registry_and_csv(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path))
    assert r.graphs() == [] and r.graph_info("a") is None
    assert r.create_graph("a", "first", owner="me") == {"name": "a", "description": "first", "owner": "me"}
    r.save_schema("a", world())
    r.create_graph("b")
    r.create_graph("a", "second")
    assert r.graphs() == ["a", "b"] and r.graph_info("a") == {"name": "a", "description": "second"} and r.load_schema("a") == world() and r.load_schema("b") is None
    (tmp_path / "n.csv").write_text('id,properties\n1,"{""type"": ""x, y""}"\n')
    (tmp_path / "e.csv").write_text("id,start_id,end_id,properties\n")
    n, _ = registry.from_csv(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"), "id bigint, properties string", "id bigint, start_id bigint, end_id bigint, properties string", bags=True)
    assert [x["properties"].toPython() for x in n.collect()] == [{"type": "x, y"}]


def test_temporary_tables_can_be_released(spark):
    path = lineage.temporary(spark, "x")
    spark.range(3).write.parquet(path)
    lineage.release(spark)
    fs, p = lineage._file_system(spark, path)
    assert not fs.exists(p)


DOC = {"id": "7", "properties": {"name": "Ann", "tags": ["b", "a", "b"], "n": 3, "x": None, "deep": {"k": [1, [2, [3]]]}}}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (".properties.name", ["Ann"]),
        ('."properties"["name"]', ["Ann"]),
        (".properties.tags[]", ["b", "a", "b"]),
        (".properties.tags[-1], .properties.tags[9], .properties.tags[1:]", ["b", None, ["a", "b"]]),
        (".properties.name[0:2]", ["An"]),
        ('"\\(.id): \\(.properties.tags | join("+")) \\u00e9"', ["7: b+a+b é"]),
        ("(1, 2) + (10, 20)", [11, 12, 21, 22]),
        ('.properties.x // .properties.nothing // "none"', ["none"]),
        ('(.properties.name | tonumber)? // "no number"', ["no number"]),
        ("[.properties.tags[] | select(. != \"a\")] | length", [2]),
        (".properties.tags | unique, sort, reverse, first, last, add", [["a", "b"], ["a", "b", "b"], ["b", "a", "b"], "b", "b", "bab"]),
        (".properties.deep.k | flatten, flatten(1)", [[1, 2, 3], [1, 2, [3]]]),
        (".properties | has(\"n\"), (.tags | has(5)), (.n | type), (.name | startswith(\"A\") and endswith(\"n\"))", [True, False, "number", True]),
        ('"a,b" | split(","), ltrimstr("a"), rtrimstr("b"), ascii_upcase', [["a", "b"], ",b", "a,", "A,B"]),
        (".properties.n - 1 < 3 and (null | not)", [True]),
        ("[1, null, \"s\", [], {}] | 1", None),
        ("[1, null, \"s\", [2]] | [.[] | values], [.[] | strings], [.[] | arrays], [.[] | numbers]", [[1, "s", [2]], ["s"], [[2]], [1]]),
        ("[empty]", [[]]),
        (".properties.tags - [\"b\"]", [["a"]]),
        ("[1, [2], null, \"a\", true] | sort | tojson", ['[null,true,1,"a",[2]]']),
        ("-2 | length", [2]),
        ("null, true, false, 1.5 | tostring", ["null", "true", "false", "1.5"]),
        (".properties | map(type) | length", [5]),
    ],
)
def test_filters_run(text, want):
    if want is None:
        with pytest.raises(ProjectionError):
            compile_filter(text)
        return
    assert list(projection.run(compile_filter(text).root, DOC)) == want


@pytest.mark.parametrize("bad", ["", ".", ".a |", "env", "input", "$x", "def f: 1; f", "reduce .[] as $x (0; . + $x)", "1 < 2 < 3", "join(.a)", "map", "length(1)", "[1", '"abc', '"\\(1"', ".[1.5]", ".[:]", "." + "a" * 2001, "(" * 41 + "1" + ")" * 41, "..", "-.a"])
def test_filters_that_are_refused(bad):
    if bad == ".":
        assert compile_filter(bad).paths == {()}
        return
    with pytest.raises(ProjectionError):
        compile_filter(bad)


def test_what_filters_read_and_grow():
    reads = lambda t: {".".join(p) for p in compile_filter(t).paths}
    assert reads(".a.b, (.c | .d[0])") == {"a.b", "c.d"}
    assert reads("select(.x == 1) | .y") == {"x", "y"}
    assert reads(".a | tojson") == {"a"} and reads("tojson") == {""} and reads("[.a] | .[0].b") == {"a"}
    assert reads(".a // .b") == {"a", "b"} and reads('"x"') == set()
    assert compile_filter(".a.b | length", ["a"]).document is not None
    with pytest.raises(ProjectionError):
        compile_filter(".a, .secret", ["a"])
    with pytest.raises(ProjectionError):
        compile_filter(".", ["a"])
    for bad in ("[.[] + .[]] | tojson", "[.[] | [., .]] | map(map(., .)) | map(map(map(., ., ., .))) | tojson | tojson | tojson", '[.[] as $x | $x]'):
        with pytest.raises(ProjectionError):
            compile_filter(bad)
    # the bound holds for what comes out
    for text in ('[.[]? | [., "abc"]] | tojson', 'map(tostring) | join(", ")', '.a | split("")', '"\\(.) and \\(.)"', ".a, .b, [.a, .b]"):
        f = compile_filter(text)
        for value in ({"a": "x" * 50, "b": "\"quoted\""}, {"a": "", "b": "\\" * 9}):
            size = len(json.dumps(value, separators=(",", ":")))
            out = sum(len(json.dumps(x, separators=(",", ":"))) for x in projection.run(f.root, value))
            assert out <= f.growth.size[0] * size + f.growth.size[1]
    total = lambda t: projection.is_total(compile_filter(t).root)
    assert total('"\\(.a)"') and total('.a // "x"') and not total(".a.b") and not total(".a[]") and not total(".a + .b")


def test_rerank_by_filters(g):
    lengths = lambda q, docs: [len(d) for d in docs]
    r = rerank.Rerank(lengths, "q", '.properties.name', candidates=4)
    assert {x["id"] for x in g.traverse(Start(keep=2, rerank=r)).nodes.collect()} == {4, 1}
    # documents of the ways to a node
    seen = []
    asks = lambda q, docs: seen.extend(docs) or [len(d) for d in docs]
    ways = rerank.Rerank(asks, "q", '"\\(.properties.name): \\([.paths[] | map(.properties.name) | join("-")] | join(", "))"', candidates=5)
    g.traverse(Start(where={"name": "Arden"}), Hop(hops=(1, 3), keep=2, rerank=ways)).nodes.collect()
    assert set(seen) == {"Brill: Arden", "Cove: Arden, Arden-Brill", "Dunmore: Arden-Cove, Arden-Brill-Cove"}
    each = rerank.Rerank(asks, "q", '[.paths[0][].properties.name] | join(" ")', candidates=5, per_path=True)
    seen.clear()
    got = g.traverse(Start(where={"name": "Arden"}), Hop(hops=(1, 3), keep=1, rerank=each))
    assert {x["id"] for x in got.edges.collect()} == {11, 12, 13, 14} and sorted(seen) == ["Arden", "Arden", "Arden Brill", "Arden Brill Cove", "Arden Cove"]
    with pytest.raises(GraphError):
        g.traverse(Start(keep=1, rerank=ways))
    # results in another order, by index
    back = rerank.Rerank(lambda q, docs: [{"index": i, "score": float(i)} for i in reversed(range(len(docs)))], "q", ".id", candidates=4)
    assert back.scores([{"id": 1}, {"id": 2}]) == [0.0, 1.0]
    with pytest.raises(GraphError):
        rerank.Rerank(lambda q, docs: [{"index": 0, "score": 1.0}] * len(docs), "q", ".id").scores([{"id": 1}, {"id": 2}])
    policy = rerank.RerankPolicy(r, ["id", "properties.name"], max_candidates=4)
    spec = {"start": {"keep": 1, "rerank": {"document_from": '"\\(.id)\\(.properties.name)"', "candidates": 4}}}
    assert {x["id"] for x in g.traverse_json(spec, rerank=policy).nodes.collect()} == {4}
    for bad in ({"document_from": ".properties.people"}, {"candidates": 5}, {"scorer": 1}, {"document_from": 1}):
        with pytest.raises(GraphError):
            policy.parse(bad)
    with pytest.raises(GraphError):
        g.traverse_json(spec)


def test_approximate_index_is_completed(spark):
    import numpy as np

    from graphloom.operators.ann import PlaneIndex

    r = np.random.default_rng(3)
    x = r.normal(size=(400, 16)).astype(np.float32)
    nodes = spark.createDataFrame([(i, i % 50, v.tolist()) for i, v in enumerate(x)] + [(1000, 0, None), (1001, 0, [1.0])], "id long, part int, vec_v array<float>")
    g = PropertyGraph.create(nodes, spark.createDataFrame([], "id long, start_id long, end_id long"))
    index = PlaneIndex.build(g, "v", 16, tables=10, planes=5)
    hit = 0
    for q in range(5):
        near = Near("v", x[q] + r.normal(size=16) * 0.1)
        want = [a["id"] for a in g.vector_search(near, k=5).collect()]
        got = [a["id"] for a in index.search(g, near, k=5).collect()]
        assert got[0] == q
        hit += len({*want} & {*got})
    assert hit >= 22
    # the filter leaves 8 rows, of which the buckets hold hardly any
    near = Near("v", -x[7])
    want = [(a["id"], round(a["similarity"], 5)) for a in g.vector_search(near, k=8, where={"part": 7}).collect()]
    assert [(a["id"], round(a["similarity"], 5)) for a in index.search(g, near, k=8, where={"part": 7}).collect()] == want and len(want) == 8
