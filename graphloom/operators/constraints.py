"""Rules that rows must keep: checked on demand, and on every write once declared on a graph."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import ConstraintViolation, GraphError
from graphloom.functions.filters import compile_filter
from graphloom.functions.props import JSON_TYPES


class Rule:
    """One rule over the nodes or the edges of a graph."""

    target: str
    where: object

    def _rows(self, g) -> tuple[DataFrame, object]:
        if self.target not in ("nodes", "edges"):
            raise GraphError("target is 'nodes' or 'edges'")
        rows, access = (g.nodes, g.node_access) if self.target == "nodes" else (g.edges, g.edge_access)
        return rows.where(compile_filter(self.where, access)) if self.where is not None else rows, access

    def broken(self, access) -> Column:
        raise NotImplementedError

    def violations(self, g) -> DataFrame:
        """Ids of the rows that break the rule."""
        rows, access = self._rows(g)
        return rows.where(self.broken(access)).select("id")

    def enforce(self, g) -> None:
        bad = self.violations(g).limit(1).collect()
        if bad:
            raise ConstraintViolation(str(self), f"row {bad[0]['id']}")


#: Columns of the tables that aren't properties.
COLUMNS = ("id", "graph_id", "start_id", "end_id")


@dataclass(frozen=True)
class Col:
    """A column of the table itself, where a bare name means a property."""

    name: str

    def __post_init__(self):
        if self.name not in COLUMNS:
            raise GraphError(f"a column is one of {COLUMNS}, not {self.name!r}")


def key_name(key: str | Col) -> str:
    return key.name if isinstance(key, Col) else key


def key_text(access, key: str | Col) -> Column:
    """The value at a property or column, as text."""
    return F.col(key.name).cast("string") if isinstance(key, Col) else access.text(key)


class Unique(Rule):
    """No two rows with the same values at all keys; rows without a value at one of them don't count."""

    def __init__(self, *keys: str | Col, where: object = None, target: str = "nodes"):
        if not keys:
            raise GraphError("Unique needs a key")
        bare = [k for k in keys if k in COLUMNS]
        if bare:
            raise GraphError(f"{bare[0]!r} is a column: write Col({bare[0]!r})")
        self.keys, self.where, self.target = keys, where, target

    def __repr__(self):
        return f"Unique{self.keys}"

    def violations(self, g) -> DataFrame:
        rows, access = self._rows(g)
        named = {f"__k{i}": key_text(access, k) for i, k in enumerate(self.keys)}
        keyed = rows.withColumns(named).select("id", *named).dropna(subset=[*named])
        twice = keyed.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return keyed.join(twice, [*named], "left_semi").select("id")


class Required(Rule):
    """Every row has the keys; an explicit null will do."""

    def __init__(self, *keys: str, where: object = None, target: str = "nodes"):
        self.keys, self.where, self.target = keys, where, target

    def __repr__(self):
        return f"Required{self.keys}"

    def broken(self, access) -> Column:
        out = F.lit(False)
        for k in self.keys:
            out = out | ~access.has(k)
        return out


@dataclass
class PropertyType(Rule):
    """A value at the key has one JSON type; no value will do."""

    key: str
    json_type: str
    where: object = None
    target: str = "nodes"

    def __post_init__(self):
        if self.json_type not in JSON_TYPES:
            raise GraphError(f"a JSON type is one of {JSON_TYPES}")

    def broken(self, access) -> Column:
        return F.coalesce(access.json_type(self.key) != self.json_type, F.lit(False))


@dataclass
class Check(Rule):
    """A filter that no row may fail; a null outcome passes."""

    filter: object
    name: str
    where: object = None
    target: str = "nodes"

    def broken(self, access) -> Column:
        return F.coalesce(~compile_filter(self.filter, access, False), F.lit(False))


class Index:
    """Rows by these keys, for speed only: it has no effect on what is found. ``write`` lays a table out by them."""

    def __init__(self, *keys: str | Col, target: str = "nodes"):
        if not keys:
            raise GraphError("Index needs a key")
        self.keys, self.target = keys, target

    def write(self, g, path: str) -> None:
        """The table, sorted by the keys within files that each hold a range of them, so that scans skip files and row groups."""
        rows, access = (g.nodes, g.node_access) if self.target == "nodes" else (g.edges, g.edge_access)
        named = {f"__k{i}": F.col(k.name) if isinstance(k, Col) else access.raw(k) if "properties" not in rows.columns else access.text(k) for i, k in enumerate(self.keys)}
        rows.withColumns(named).repartitionByRange(*named).sortWithinPartitions(*named).drop(*named).write.parquet(path)


def define(g, rules: Sequence[Rule]):
    """``g`` with rules; refused if its rows break one already."""
    for r in rules:
        r.enforce(g)
    return dataclasses.replace(g, rules=[*g.rules, *rules])


def drop(g, *rules: Rule):
    return dataclasses.replace(g, rules=[r for r in g.rules if r not in rules])


def report(g, rules: Sequence[Rule], sample: int = 5) -> list[dict]:
    """How many rows break each rule, and the smallest ids of some of them."""
    out = []
    for r in rules:
        bad = r.violations(g)
        ids = [str(x["id"]) for x in bad.orderBy("id").limit(sample).collect()]
        out.append({"rule": str(r), "count": bad.count() if ids else 0, "sample": ids})
    return out
