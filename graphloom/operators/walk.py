"""Bounded walks over edges.

A hop starts at anchors, takes ``low`` to ``high`` edges that pass ``via``, and lands on nodes that pass ``where``. No node is
visited twice in one hop's walk, but for the first step, which isn't checked. Reported are the edges of all walks that end
in the hop's matches with at least ``low`` edges.

* one edge: a join, no state at all;
* acyclic edges: by layers. Each step's edges are those that leave the nodes the step before led to; on the way back a step
  keeps the edges that end in a match or where a kept edge of the next step begins. The cost is that of the edges, not of the paths;
* matches only, from one edge on: two anchors a node are enough to know (``reached``);
* else: walks with their paths, over the edges that the layers leave (they never leave too few).

Joins are spread by the size of what is joined, not by what is left of it when compressed, so that no task grows with the input.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import lineage


@dataclass
class Walked:
    """Matches (id) of a hop, and the edges it reports, with ``from_id``, ``to_id`` and all other columns."""

    match: DataFrame
    edges: DataFrame
    walks: DataFrame | None = None


def _land(reached: DataFrame, targets: DataFrame | None, column: str = "to_id") -> DataFrame:
    return reached if targets is None else reached.join(targets.select(F.col("id").alias(column)), column, "left_semi")


def single(anchors: DataFrame, edges: DataFrame, targets: DataFrame | None) -> Walked:
    """Walks of one edge."""
    taken = _land(edges.join(anchors.select(F.col("id").alias("from_id")), "from_id", "left_semi"), targets)
    return Walked(taken.select(F.col("to_id").alias("id")).distinct(), taken)


#: Steps that the bits of a long had room for; no limit of walks.
WORD = 62
#: Ids may tell their type by their remainder (``sources.tables``): what has another one than it needs isn't shuffled at all.
CODES = 16


def codes(ids: DataFrame) -> list[int] | None:
    """The remainders of some ids; None where all occur or ids aren't whole numbers."""
    if not isinstance(ids.schema["id"].dataType, T.IntegralType):
        return None
    found = [r[0] for r in ids.where("id is not null").select(F.pmod("id", F.lit(CODES)).alias("code")).distinct().collect()]
    return None if len(found) == CODES else found


def coded(column: str, among: list[int] | None):
    """Whether an id has one of the remainders."""
    if among is None:
        return F.lit(True)
    return F.pmod(column, F.lit(CODES)).isin(among) if among else F.lit(False)


def _meet(rows: DataFrame, ids: DataFrame, column: str, parts: int) -> DataFrame:
    """Rows whose ``column`` is among the ids, which may repeat. A semi-join would go into every branch of a union."""
    few = ids.select(F.col("id").alias(column)).repartition(parts, column).distinct()
    return rows.repartition(parts, column).join(few, column).select(*rows.columns)


def layered(anchors: DataFrame, edges: DataFrame, targets: DataFrame | None, low: int, high: int, want_edges: bool = True) -> Walked:
    """Exact where the edges reachable from the anchors have no cycle; elsewhere a superset.

    Each step's edges are written out, so every step shuffles only edges that may be in it, and the way back only what was reached.
    """
    parts = lineage.parts(edges)
    front = lineage.cut(anchors.select("id").distinct())
    ends = None if targets is None else codes(targets)
    taken, sources = [], []
    for d in range(high):
        sources.append(codes(front))
        fit = edges.where(coded("from_id", sources[-1]))
        if d == high - 1:
            fit = fit.where(coded("to_id", ends))
        step = _meet(fit if want_edges else fit.select("from_id", "to_id"), front, "from_id", parts)
        taken.append(lineage.cut(step if want_edges else step.select("to_id").distinct()))
        front = taken[-1].select(F.col("to_id").alias("id"))
    reached = reduce(DataFrame.unionByName, (t.where(coded("to_id", ends)).select(F.col("to_id").alias("id")) for t in taken[low - 1 :]))
    match = reached.distinct() if targets is None else _meet(targets.select("id").distinct(), reached, "id", parts)
    if not want_edges:
        return Walked(match, edges.limit(0))
    kept: list[DataFrame] = []
    for d in reversed(range(high)):
        last = d + 1 >= low
        if last and targets is None:
            kept.append(taken[d])
            continue
        on = [targets.select("id")] if last else []
        if kept:
            on.append(kept[-1].select(F.col("from_id").alias("id")))
        keep = _meet(taken[d], reduce(DataFrame.unionByName, on), "to_id", parts)
        kept.append(lineage.cut(keep) if d else keep)
    out = reduce(DataFrame.unionByName, kept)
    # an edge that belongs to two steps is reported once; where the steps start from different codes there is none
    apart = None not in sources and len({c for s in sources for c in s}) == sum(map(len, sources))
    return Walked(match, out if apart else out.repartition(parts, "id").dropDuplicates(["id"]))


def reached(anchors: DataFrame, edges: DataFrame, targets: DataFrame | None, high: int) -> DataFrame:
    """Nodes (id) at the end of walks of 1 to ``high`` edges, on any graph, without the walks.

    The shortest way from an anchor to another node visits none twice, so a node is reached if an anchor other than itself is within
    ``high`` edges, or by a loop at an anchor. To know that, a node needs two of the anchors that are near it, whichever: two
    are passed on as soon as there are two, so that no node has fewer than two of more.
    """
    steps = lineage.cut(edges.select("from_id", "to_id"))
    parts = lineage.parts_of_rows(steps)
    state = lineage.cut(anchors.select("id").distinct().select("id", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(True).alias("new")))
    for _ in range(high):
        new = state.where("new").select(F.col("id").alias("from_id"), "a", "b").repartition(parts, "from_id")
        sent = steps.repartition(parts, "from_id").join(new, "from_id").select(F.col("to_id").alias("id"), "a", "b")
        none = F.lit(None).cast(state.schema["id"].dataType)
        met = state.select("id", "a", "b", F.col("a").alias("old_a"), F.col("b").alias("old_b")).unionByName(sent.select("id", "a", "b", none.alias("old_a"), none.alias("old_b")))
        met = met.repartition(parts, "id").groupBy("id").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("old_a").alias("old_a"), F.max("old_b").alias("old_b"))
        two = F.coalesce(F.col("old_a") != F.col("old_b"), F.lit(False))
        new = F.col("old_a").isNull() | ~two & (F.col("a") != F.col("b"))
        state = lineage.cut(met.select("id", F.when(two, F.col("old_a")).otherwise(F.col("a")).alias("a"), F.when(two, F.col("old_b")).otherwise(F.col("b")).alias("b"), new.alias("new")))
        if state.where("new").isEmpty():
            break
    others = state.where("a <> id or b <> id").select("id")
    loops = steps.where("from_id = to_id").select(F.col("from_id").alias("id"))
    found = others.unionByName(_meet(anchors.select("id").distinct(), loops, "id", parts))
    found = found.repartition(parts, "id").distinct()
    return found if targets is None else _meet(found, targets, "id", parts)


def enumerated(anchors: DataFrame, edges: DataFrame, targets: DataFrame | None, low: int, high: int) -> Walked:
    """Every walk with its path; exact on any graph."""
    if high > 2:
        near = layered(anchors, edges, targets, low, high)
        edges = lineage.cut(near.edges)
    step = edges.select("id", F.col("from_id").alias("at"), F.col("to_id").alias("next"))
    first = anchors.select("id").distinct().select(F.col("id").alias("at")).join(step, "at")
    walks = [first.select(F.col("next").alias("to_id"), F.array("at", "next").alias("path"), F.array("id").alias("edge_ids"))]
    for _ in range(high - 1):
        # each depth is written out, so that none is walked again for those after it
        walks[-1] = lineage.cut(walks[-1])
        parts = lineage.parts_of_rows(walks[-1])
        w = walks[-1].withColumnRenamed("to_id", "at").repartition(parts, "at").join(step.repartition(parts, "at"), "at").where(~F.array_contains("path", F.col("next")))
        walks.append(w.select(F.col("next").alias("to_id"), F.array_append("path", F.col("next")).alias("path"), F.array_append("edge_ids", F.col("id")).alias("edge_ids")))
    landed = _land(reduce(DataFrame.unionByName, walks[low - 1 :]), targets)
    taken = landed.select(F.explode("edge_ids").alias("id")).distinct()
    return Walked(landed.select(F.col("to_id").alias("id")).distinct(), edges.join(taken, "id", "left_semi"), landed)


def is_acyclic(edges: DataFrame) -> bool:
    """Whether all edges lead to larger ids, or all to smaller ones: one pass, sufficient but not necessary."""
    r = edges.agg(F.max(F.when(F.col("from_id") >= F.col("to_id"), 1)).alias("down"), F.max(F.when(F.col("from_id") <= F.col("to_id"), 1)).alias("up")).first()
    return r["down"] is None or r["up"] is None


def walk(anchors: DataFrame, edges: DataFrame, targets: DataFrame | None, low: int, high: int, acyclic: bool | None, want_edges: bool = True) -> Walked:
    """The cheapest exact way. ``acyclic``: known of the edges, or None to look at their ids."""
    if high == 1:
        return single(anchors, edges, targets)
    if acyclic is None:
        acyclic = is_acyclic(edges)
    if acyclic:
        return layered(anchors, edges, targets, low, high, want_edges)
    if not want_edges and low == 1:
        return Walked(reached(anchors, edges, targets, high), edges.limit(0))
    return enumerated(anchors, edges, targets, low, high)
