"""Walk strategies against plain enumeration of walks on small random graphs."""

import random

import pytest

from graphloom.operators import walk


def brute(anchors, edges, targets, low, high):
    walks = [([a, t], [i], t) for a in set(anchors) for i, s, t in edges if s == a]
    every = [(1, w) for w in walks]
    for d in range(2, high + 1):
        walks = [([*p, t], [*es, i], t) for p, es, at in walks for i, s, t in edges if s == at and t not in p]
        every += [(d, w) for w in walks]
    landed = [w for d, w in every if d >= low and (targets is None or w[2] in targets)]
    return {w[2] for w in landed}, {e for w in landed for e in w[1]}


def frames(spark, anchors, edges, targets):
    a = spark.createDataFrame([(x,) for x in anchors], "id long")
    e = spark.createDataFrame(edges, "id long, from_id long, to_id long")
    return a, e, None if targets is None else spark.createDataFrame([(x,) for x in targets], "id long")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("acyclic", [True, False])
def test_walks(spark, seed, acyclic):
    r = random.Random(seed)
    n = 7
    edges = [(i, *((max(x), min(x)) if acyclic else x)) for i, x in enumerate((r.randrange(n), r.randrange(n)) for _ in range(12))]
    edges = [e for e in edges if not acyclic or e[1] != e[2]]
    anchors, targets = r.sample(range(n), 3), r.choice([None, r.sample(range(n), 4)])
    low = r.randint(1, 2)
    high = low + r.randint(0, 2)
    got = walk.walk(*frames(spark, anchors, edges, targets), low, high, None)
    match, taken = brute(anchors, edges, targets, low, high)
    assert {x["id"] for x in got.match.collect()} == match
    found = [x["id"] for x in got.edges.collect()]
    assert set(found) == taken and len(found) == len(taken)


def test_walks_longer_than_a_word_of_bits(spark):
    n = walk.WORD + 9
    edges = [(i, i, i + 1) for i in range(n)] + [(n + i, i, i + 2) for i in range(0, 6, 2)]
    got = walk.walk(*frames(spark, [0], edges, [n]), n - 1, n, True)
    match, taken = brute([0], edges, [n], n - 1, n)
    assert {x["id"] for x in got.match.collect()} == match == {n}
    assert sorted(x["id"] for x in got.edges.collect()) == sorted(taken)


def test_self_loop_counts_as_a_first_step(spark):
    got = walk.walk(*frames(spark, [1], [(0, 1, 1)], None), 1, 3, None)
    assert [x["id"] for x in got.match.collect()] == [1]


@pytest.mark.parametrize("name", ["g_walk_range_edges", "g_walk_exact", "g_walk_cycles_edges", "g_walk_cycles_count", "g_bag_traverse", "g_walk_all_edges"])
def test_walks_from_all_nodes_are_those_of_the_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from graphloom import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders", "lineitem", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = sorted(con.execute(queries.ORACLES[name]).fetchall())
    assert want and sorted(map(tuple, queries.QUERIES[name](spark, d).collect())) == want


@pytest.mark.parametrize("seed", range(6))
def test_matches_on_cycles_need_no_walks(spark, monkeypatch, seed):
    def no(*args):
        raise AssertionError("walks were listed")

    monkeypatch.setattr(walk, "enumerated", no)
    r = random.Random(seed)
    n = 9
    edges = [(i, r.randrange(n), r.randrange(n)) for i in range(11)]
    anchors, targets, high = r.sample(range(n), r.randint(1, 3)), r.choice([None, r.sample(range(n), 5)]), r.randint(2, 5)
    got = walk.walk(*frames(spark, anchors, edges, targets), 1, high, False, want_edges=False)
    found = [x["id"] for x in got.match.collect()]
    assert sorted(found) == sorted(brute(anchors, edges, targets, 1, high)[0])


def test_an_anchor_on_a_circle_is_reached_only_from_another_one(spark):
    edges = [(0, 1, 2), (1, 2, 3), (2, 3, 1), (3, 7, 7)]
    for anchors, want in (([1], {2, 3}), ([1, 2], {1, 2, 3}), ([7], {7}), ([8], set())):
        got = walk.walk(*frames(spark, anchors, edges, None), 1, 4, False, want_edges=False)
        assert {x["id"] for x in got.match.collect()} == want == brute(anchors, edges, None, 1, 4)[0]


@pytest.mark.parametrize(("low", "high"), [(1, 3), (2, 2)])
def test_layers_leave_out_what_does_not_fit(spark, monkeypatch, low, high):
    # customers 3, orders 6, parts 5, suppliers 4 by the remainder
    edges = [(i, i * 16 + 3, i * 16 + 6) for i in range(4)] + [(10 + i, i * 16 + 6, i % 2 * 16 + 5) for i in range(4)] + [(20 + i, i * 16 + 5, i * 16 + 4) for i in range(2)]
    written, cut = [], walk.lineage.cut

    def counted(df):
        out = cut(df)
        if "from_id" in out.columns:
            written.append(sorted(x["id"] for x in out.collect()))
        return out

    monkeypatch.setattr(walk.lineage, "cut", counted)
    anchors, targets = [3, 19], [5, 21]
    got = walk.walk(*frames(spark, anchors, edges, targets), low, high, True)
    assert "Deduplicate [id#" not in got.edges._jdf.queryExecution().analyzed().toString()
    assert sorted(x["id"] for x in got.edges.collect()) == sorted(brute(anchors, edges, targets, low, high)[1]) == [0, 1, 10, 11]
    assert not any(i >= 20 for ids in written for i in ids)


def test_deletes_join_the_edges_and_not_each_kind_of_them(spark):
    from graphloom.operators import mutate
    from graphloom.sources import tables

    g = tables.order_graph(spark, "/root/testdata/sf0.001")
    after = mutate.delete_nodes(g, {"type": "customer", "c_mktsegment": "BUILDING"}, detach=True).graph
    plan = after.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_endpoint_counts_spread_by_what_is_read(spark, monkeypatch):
    from graphloom.operators import schema
    from graphloom.sources import tables

    g = tables.order_graph(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(walk.lineage, "PART_BYTES", 20_000)
    n = walk.lineage.parts(g.edges)
    plan = schema.endpoint_counts(g)._jdf.queryExecution().optimizedPlan().toString()
    assert n > 8 and plan.count("RepartitionByExpression") == 4 and f", {n}" in plan
