"""Writes. A graph is an immutable snapshot: every operation gives a new graph, and a plan of several is all or nothing.

Nothing is written in place; ``sources.snapshots`` saves a graph as a new version.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.errors import ConstraintViolation, GraphError
from graphloom.functions import filters
from graphloom.functions.props import bag
from graphloom.operators import lineage, walk
from graphloom.operators.constraints import COLUMNS, Col, Unique, key_name, key_text


@dataclass
class Change:
    """The new graph, and how many rows an operation matched or added."""

    graph: object
    nodes: int = 0
    edges: int = 0


def _is_bag(t: DataFrame) -> bool:
    return "properties" in t.columns


def _rows(g, rows: Sequence[dict] | DataFrame, table: DataFrame, reserved: Sequence[str]) -> DataFrame:
    """New rows as a DataFrame of the table's layout; dictionaries are flat or have a ``properties`` object."""
    if isinstance(rows, DataFrame):
        return rows
    flat = []
    for r in rows:
        own = {k: r[k] for k in reserved if k in r}
        rest = {k: v for k, v in r.items() if k not in reserved}
        if "properties" in rest:
            if set(rest) != {"properties"} or not isinstance(rest["properties"], dict):
                raise GraphError("a row has either properties or flat keys, and properties is an object")
            rest = rest["properties"]
        for k, v in rest.items():
            if isinstance(v, list) and v and all(isinstance(x, float) for x in v) and f"vec_{k}" in table.columns:
                raise GraphError(f"{k!r} is a vector field: vectors don't go into properties")
        flat.append((own, rest))
    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    spark = g.spark
    ids = [c for c in reserved if c in table.columns]
    if _is_bag(table):
        data = [(*(own.get(c) for c in ids), json.dumps(rest)) for own, rest in flat]
        schema = ", ".join(f"`{c}` {types[c]}" for c in ids) + ", properties string"
        return spark.createDataFrame(data, schema).withColumn("properties", F.parse_json("properties"))
    keys = [k for k in dict.fromkeys(k for _, rest in flat for k in rest)]
    new = {k: spark.createDataFrame([(next(rest[k] for _, rest in flat if rest.get(k) is not None),)], ["x"]).schema[0].dataType.simpleString() for k in keys if k not in types and any(rest.get(k) is not None for _, rest in flat)}
    keys = [k for k in keys if k in types or k in new]
    data = [(*(own.get(c) for c in ids), *(rest.get(k) for k in keys)) for own, rest in flat]
    return spark.createDataFrame(data, ", ".join(f"`{c}` {types.get(c) or new[c]}" for c in [*ids, *keys]))


def _with_ids(rows: DataFrame, table: DataFrame, dense: bool = True) -> DataFrame:
    """New rows with ids above those of the table, consecutive ones if ``dense``."""
    missing = rows.where("id is null").limit(1).count() if "id" in rows.columns else 1
    if not missing:
        twice = rows.select("id").unionByName(table.select("id").join(rows.select("id"), "id", "left_semi")).groupBy("id").count().where("count > 1").limit(1).collect()
        if twice:
            raise ConstraintViolation("id", f"{twice[0]['id']} is there already")
        return rows
    if "id" in rows.columns and rows.where("id is not null").limit(1).count():
        raise GraphError("either all rows have an id or none")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    if not dense:
        # written out, as a row's number depends on where it is computed
        return lineage.cut(rows.drop("id").withColumn("id", F.monotonically_increasing_id() + F.lit(top + 1)))
    # rows that came as a list: one ordering of them is fine
    order = W.orderBy(F.monotonically_increasing_id())
    return rows.drop("id").withColumn("id", F.row_number().over(order) + F.lit(top))


def _scoped(g, rows: DataFrame) -> DataFrame:
    return rows.withColumn(g.graph_col, F.lit(g.name)) if g.graph_col else rows


def _replace(g, **tables) -> object:
    new = dataclasses.replace(g, **tables)
    for rule in new.rules:
        rule.enforce(new)
    return new


def add_nodes(g, rows) -> Change:
    new = _scoped(g, _with_ids(_rows(g, rows, g.nodes_table, ("id",)), g.nodes_table, not isinstance(rows, DataFrame)))
    return Change(_replace(g, nodes_table=g.nodes_table.unionByName(new, allowMissingColumns=True)), nodes=new.count())


#: References that one query looks up.
_TOGETHER = 500


def _resolve_all(g, refs: Sequence[object]) -> list[int]:
    """The node of each reference: an id, or properties that exactly one node has. One query for many of them."""
    named: dict[str, dict] = {json.dumps(r, sort_keys=True, default=str): r for r in refs if isinstance(r, dict)}
    out: dict[str, int] = {}
    keys = list(named)
    for at in range(0, len(keys), _TOGETHER):
        part = keys[at : at + _TOGETHER]
        hits = F.array(*(F.when(filters.compile_filter(named[k], g.node_access) if named[k] else F.lit(True), F.lit(i)) for i, k in enumerate(part)))
        found = g.nodes.select("id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("ref"))
        few = {r["ref"]: r for r in found.groupBy("ref").agg(F.min("id").alias("id"), F.count("*").alias("n")).collect()}
        for i, k in enumerate(part):
            if i not in few or few[i]["n"] != 1:
                raise GraphError(f"{named[k]!r} names {'no node' if i not in few else 'more than one node'}")
            out[k] = few[i]["id"]
    return [out[json.dumps(r, sort_keys=True, default=str)] if isinstance(r, dict) else int(r) for r in refs]


def _resolve(g, ref: object) -> int:
    return _resolve_all(g, [ref])[0]


def _check_ends(g, edges: DataFrame) -> None:
    ends = edges.select(F.col("start_id").alias("id")).union(edges.select("end_id"))
    lost = ends.join(g.nodes.select("id"), "id", "left_anti").limit(1).collect()
    if lost:
        raise ConstraintViolation("endpoint", f"there is no node {lost[0]['id']} in this graph")


def add_edges(g, rows) -> Change:
    """Ends are ids, or properties that exactly one node has."""
    if not isinstance(rows, DataFrame):
        ends = _resolve_all(g, [r[c] for r in rows for c in ("start_id", "end_id")])
        rows = [{**r, "start_id": s, "end_id": e} for r, s, e in zip(rows, ends[::2], ends[1::2])]
    new = _scoped(g, _with_ids(_rows(g, rows, g.edges_table, ("id", "start_id", "end_id")), g.edges_table, not isinstance(rows, DataFrame)))
    _check_ends(g, new)
    return Change(_replace(g, edges_table=g.edges_table.unionByName(new, allowMissingColumns=True)), edges=new.count())


def _merged(table: DataFrame, rows: DataFrame, on: Sequence[str], access, scope: Column, replace: bool) -> DataFrame:
    """Rows that are there get the new values; others stay as they are."""
    names = [key_name(k) for k in on]
    if _is_bag(table):
        ends = [c for c in ("start_id", "end_id") if c in rows.columns]
        new = rows.select(*(key_text(access, k).alias(f"__k{i}") for i, k in enumerate(on)), F.col("properties").alias("__new"), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__v_{c}") for c in ends))
        t = table.withColumns({f"__t{i}": key_text(access, k) for i, k in enumerate(on)})
        joined = t.join(new, [scope & (t[f"__t{i}"] == new[f"__k{i}"]) for i in range(len(on))], "left")
        value = F.col("__new") if replace else merge_bags(F.col("properties"), F.col("__new"))
        values = {"properties": F.when(F.col("__hit"), value).otherwise(F.col("properties"))} | {c: F.when(F.col("__hit"), F.col(f"__v_{c}")).otherwise(F.col(c)) for c in ends}
        return joined.withColumns(values).select(*table.columns)
    own = [c for c in rows.columns if c not in names and c != "id"]
    new = rows.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(names)), *(F.col(c).alias(f"__v_{c}") for c in own), F.lit(True).alias("__hit"))
    joined = table.join(new, [scope & (table[k] == new[f"__k{i}"]) for i, k in enumerate(names)], "left")
    out = []
    for c in [*table.columns, *(c for c in own if c not in table.columns)]:
        old = F.col(c) if c in table.columns else F.lit(None)
        if c in own:
            out.append(F.when(F.col("__hit"), F.col(f"__v_{c}") if replace else F.coalesce(F.col(f"__v_{c}"), old)).otherwise(old).alias(c))
        elif replace and c not in ("id", "graph_id", "start_id", "end_id", *names) and not c.startswith("vec_"):
            out.append(F.when(F.col("__hit"), F.lit(None)).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return joined.select(*out)


def merge_bags(old: Column, new: Column) -> Column:
    """The keys of both, those of ``new`` winning; not deeper than the first level."""
    a, b = old.cast("map<string,variant>"), new.cast("map<string,variant>")
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.to_variant_object(F.map_concat(kept, b))


def _merge(g, rows, on: Sequence, replace: bool, target: str) -> Change:
    nodes = target == "nodes"
    if not any(isinstance(r, Unique) and set(r.keys) == set(on) and r.where is None and r.target == target for r in g.rules):
        raise GraphError(f"merging on {list(on)} needs a declared Unique over exactly these keys")
    table, reserved = (g.nodes_table, ("id",)) if nodes else (g.edges_table, ("id", "start_id", "end_id"))
    if not nodes and not isinstance(rows, DataFrame):
        ends = _resolve_all(g, [r[c] for r in rows for c in ("start_id", "end_id")])
        rows = [{**r, "start_id": s, "end_id": e} for r, s, e in zip(rows, ends[::2], ends[1::2])]
    listed, new = not isinstance(rows, DataFrame), _rows(g, rows, table, reserved)
    access = g.node_access if nodes else g.edge_access
    a = filters.BagAccess() if _is_bag(table) else filters.TypedAccess(new, reserved)
    keys = [f"__k{i}" for i in range(len(on))]
    keyed = new.withColumns({c: key_text(a, k) for c, k in zip(keys, on)})
    fault = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where(reduce(lambda x, y: x | y, (F.col(c).isNull() for c in keys)) | (F.col("n") > 1)).limit(1).collect()
    if fault:
        raise GraphError(f"every row needs a value at {[key_name(k) for k in on]}" if None in fault[0] else f"two rows have the same values at {[key_name(k) for k in on]}")
    if not nodes:
        _check_ends(g, new)
    scope = (F.col(g.graph_col) == g.name) if g.graph_col else F.lit(True)
    there = (g.nodes if nodes else g.edges).select(*(key_text(access, k).alias(c) for c, k in zip(keys, on)))
    fresh = keyed.join(there, keys, "left_anti").drop(*keys)
    if Col("id") not in on:
        fresh = fresh.drop("id")
    several = new.count()
    merged = _merged(table, new, on, access, scope, replace)
    added = _scoped(g, _with_ids(fresh, table, listed))
    out = dataclasses.replace(g, **{f"{target}_table": merged.unionByName(added, allowMissingColumns=True)})
    return Change(_replace(out), **{target: several})


def merge_nodes(g, rows, on: Sequence, replace: bool = False) -> Change:
    """Update nodes that have the same values at ``on``, add the others; ``on`` must be a declared Unique."""
    return _merge(g, rows, on, replace, "nodes")


def merge_edges(g, rows, on: Sequence, replace: bool = False) -> Change:
    """Likewise for edges; their ends, ids or properties as in ``add_edges``, can be among the keys as ``Col``."""
    return _merge(g, rows, on, replace, "edges")


def ingest(g, spec: dict, merge_nodes_on: Sequence | None = None, merge_edges_on: Sequence | None = None) -> Change:
    """{"nodes": [...], "edges": [...]}: the nodes first, all or nothing; merged where keys to merge on are given."""
    if not isinstance(spec, dict) or set(spec) - {"nodes", "edges"}:
        raise GraphError("an ingest has nodes and edges")
    done = Change(g)
    for rows, on, add, merge in ((spec.get("nodes"), merge_nodes_on, add_nodes, merge_nodes), (spec.get("edges"), merge_edges_on, add_edges, merge_edges)):
        if rows:
            new = add(done.graph, rows) if on is None else merge(done.graph, rows, on_keys(on))
            done = Change(new.graph, done.nodes + new.nodes, done.edges + new.edges)
    return done


def on_keys(on: Sequence) -> list:
    """Keys as they come in JSON: the names of columns mean the columns."""
    return [Col(k) if k in COLUMNS else k for k in on]


def _need_filter(where, ids, all_rows: bool, *more) -> None:
    if not isinstance(all_rows, bool):
        raise GraphError("all must be True or False")
    given = where not in (None, {}) or ids is not None or any(x is not None for x in more)
    if given == all_rows:
        raise GraphError("give a filter, or all=True for every row, not both" if given else "give a filter, or all=True for every row")


def _without(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def delete_nodes(g, where=None, detach: bool = False, all: bool = False, ids: Sequence[int] | None = None) -> Change:
    """Without ``detach``, nodes with edges can't go."""
    _need_filter(where, ids, all)
    if not isinstance(detach, bool):
        raise GraphError("detach must be True or False")
    gone = g.matching(where, ids).select("id")
    among = walk.codes(gone)
    touched = walk.coded("start_id", among) | walk.coded("end_id", among)
    # edges whose ends can't be among the nodes by their codes aren't joined
    met = _marked(g.edges.where(touched).select("id", "start_id", "end_id"), gone)
    loose = met.where("gone").select("id")
    if not detach and not loose.isEmpty():
        raise ConstraintViolation("endpoint", "these nodes have edges; detach=True takes those along")
    counts = gone.count(), loose.distinct().count() if detach else 0
    nodes = _without(g.nodes_table, gone)
    if not detach:
        return Change(_replace(g, nodes_table=nodes), *counts)
    scope = F.coalesce(F.col(g.graph_col) == g.name, F.lit(False)) if g.graph_col else F.lit(True)
    near = F.coalesce(touched, F.lit(False)) & scope
    kept = _marked(g.edges_table.where(near), gone).where("not gone").drop("gone")
    return Change(_replace(g, nodes_table=nodes, edges_table=kept.select(*g.edges_table.columns).unionByName(g.edges_table.where(~near))), *counts)


def _marked(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges, and whether an end is among some nodes. Outer joins, as an anti-join would be made for each branch of the edges' union."""
    parts = lineage.parts(edges)
    out = edges
    for end in ("start_id", "end_id"):
        few = gone.select(F.col("id").alias(end), F.lit(True).alias(f"gone_{end}")).repartition(parts, end).distinct()
        out = out.repartition(parts, end).join(few, end, "left")
    return out.withColumn("gone", F.coalesce("gone_start_id", "gone_end_id", F.lit(False))).drop("gone_start_id", "gone_end_id")


def _matching_edges(g, where, start, end, ids) -> DataFrame:
    rows = g.matching_edges(where, ids)
    for side, column in ((start, "start_id"), (end, "end_id")):
        if side is not None:
            rows = rows.join(g.matching(side).select(F.col("id").alias(column)), column, "left_semi")
    return rows


def delete_edges(g, where=None, start=None, end=None, all: bool = False, ids: Sequence[int] | None = None) -> Change:
    """``start`` and ``end`` filter the nodes at the ends."""
    _need_filter(where, ids, all, start, end)
    gone = _matching_edges(g, where, start, end, ids).select("id")
    return Change(_replace(g, edges_table=_without(g.edges_table, gone)), edges=gone.count())


def _updated(table: DataFrame, hit: DataFrame, values: dict, remove: Sequence[str], replace: bool) -> DataFrame:
    if set(values) & set(remove) or replace and remove:
        raise GraphError("a key can't be both set and removed, and a replacement removes all others anyway")
    if not values and not remove and not replace:
        raise GraphError("nothing to change: give set, remove or replace")
    t = table.join(hit.select("id").withColumn("__hit", F.lit(True)), "id", "left")
    if _is_bag(table):
        old = F.col("properties").cast("map<string,variant>")
        gone = [*values, *remove]
        kept = F.map_filter(old, lambda k, _: ~k.isin(gone)) if gone else old
        new = bag(values) if replace else F.to_variant_object(F.map_concat(kept, bag(values).cast("map<string,variant>")))
        return t.withColumn("properties", F.when(F.col("__hit"), new).otherwise(F.col("properties"))).select(*table.columns)
    columns = dict.fromkeys([*table.columns, *values])
    out = []
    for c in columns:
        old = F.col(c) if c in table.columns else F.lit(None)
        if c in values:
            new = F.lit(values[c]) if c not in table.columns else F.lit(values[c]).cast(table.schema[c].dataType)
        elif c in remove or replace and c not in ("id", "graph_id", "start_id", "end_id") and not c.startswith("vec_"):
            new = F.lit(None)
        else:
            out.append(old.alias(c))
            continue
        out.append(F.when(F.col("__hit"), new).otherwise(old).alias(c))
    return t.select(*out)


def update_nodes(g, where=None, set: dict | None = None, remove: Sequence[str] = (), replace: bool = False, all: bool = False, ids: Sequence[int] | None = None) -> Change:
    """Counts the rows matched, whether or not they change."""
    _need_filter(where, ids, all)
    hit = g.matching(where, ids)
    return Change(_replace(g, nodes_table=_updated(g.nodes_table, hit, set or {}, remove, replace)), nodes=hit.count())


def update_edges(g, where=None, set: dict | None = None, remove: Sequence[str] = (), replace: bool = False, all: bool = False, ids: Sequence[int] | None = None, start=None, end=None) -> Change:
    _need_filter(where, ids, all, start, end)
    hit = _matching_edges(g, where, start, end, ids)
    return Change(_replace(g, edges_table=_updated(g.edges_table, hit, set or {}, remove, replace)), edges=hit.count())


def repoint_edge(g, edge_id: int, start_id: int | None = None, end_id: int | None = None) -> Change:
    """Other ends for one edge; its id and properties stay."""
    if start_id is None and end_id is None:
        raise GraphError("give start_id or end_id")
    if not g.edges.where(F.col("id") == edge_id).limit(1).count():
        raise GraphError(f"there is no edge {edge_id}")
    for new in (start_id, end_id):
        if new is not None and not g.nodes.where(F.col("id") == new).limit(1).count():
            raise ConstraintViolation("endpoint", f"there is no node {new} in this graph")
    t = g.edges_table
    for column, new in (("start_id", start_id), ("end_id", end_id)):
        if new is not None:
            t = t.withColumn(column, F.when(F.col("id") == edge_id, F.lit(int(new)).cast("long")).otherwise(F.col(column)))
    return Change(_replace(g, edges_table=t), edges=1)


def clear(g) -> Change:
    """Nothing of this graph stays; others in the same tables do."""
    n, e = g.nodes.count(), g.edges.count()
    none = (F.col(g.graph_col) != g.name) if g.graph_col else F.lit(False)
    return Change(_replace(g, nodes_table=g.nodes_table.where(none), edges_table=g.edges_table.where(none)), n, e)


_OPERATIONS = {f.__name__: f for f in (add_nodes, add_edges, merge_nodes, merge_edges, delete_nodes, delete_edges, update_nodes, update_edges, repoint_edge, clear)}


def mutate(g, spec: dict) -> Change:
    """{"operations": [{"op": name, ...}]} in order; if one fails, nothing happened."""
    if not isinstance(spec, dict) or set(spec) != {"operations"} or not isinstance(spec["operations"], list):
        raise GraphError("a plan is {'operations': [...]}")
    total = Change(g)
    for o in spec["operations"]:
        args = dict(o)
        name = args.pop("op", None)
        if name not in _OPERATIONS:
            raise GraphError(f"no operation {name!r}; there are {sorted(_OPERATIONS)}")
        for k in ("where", "start", "end"):
            if k in args:
                args[k] = filters.parse_filter(args[k])
        if "on" in args:
            args["on"] = on_keys(args["on"])
        try:
            done = _OPERATIONS[name](total.graph, **args)
        except TypeError as e:
            raise GraphError(f"{name}: {e}") from e
        total = Change(done.graph, total.nodes + done.nodes, total.edges + done.edges)
    return total
