"""Aggregates over what a traversal's last hop matched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.filters import Access


@dataclass(frozen=True)
class Count:
    """Matched nodes, or those that have a value at ``key``."""

    key: str | None = None
    distinct: bool = False

    def column(self, a: Access) -> Column:
        if self.key is None:
            if self.distinct:
                raise GraphError("Count(distinct=True) needs a property")
            return F.count(F.lit(1))
        return (F.count_distinct if self.distinct else F.count)(a.text(self.key))


@dataclass(frozen=True)
class Sum:
    """Of a property's numbers; 0 without any."""

    key: str
    distinct: bool = False

    def column(self, a: Access) -> Column:
        return F.coalesce((F.sum_distinct if self.distinct else F.sum)(a.number(self.key)), F.lit(0.0))


@dataclass(frozen=True)
class Avg:
    key: str
    distinct: bool = False

    def column(self, a: Access) -> Column:
        x = a.number(self.key)
        return F.sum_distinct(x) / F.count_distinct(x) if self.distinct else F.avg(x)


@dataclass(frozen=True)
class Min:
    key: str

    def column(self, a: Access) -> Column:
        return F.min(a.number(self.key))


@dataclass(frozen=True)
class Max:
    key: str

    def column(self, a: Access) -> Column:
        return F.max(a.number(self.key))


_BY_NAME = {"count": Count, "sum": Sum, "avg": Avg, "min": Min, "max": Max}


def parse_aggregate(spec: dict):
    """From {"fn", "property", "distinct"}."""
    if not isinstance(spec, dict) or set(spec) - {"fn", "property", "distinct"} or spec.get("fn") not in _BY_NAME:
        raise GraphError(f"an aggregate is {{'fn': one of {sorted(_BY_NAME)}, 'property', 'distinct'}}, not {spec!r}")
    fn, key, distinct = spec["fn"], spec.get("property"), spec.get("distinct", False)
    if not isinstance(distinct, bool):
        raise GraphError("distinct must be true or false")
    if fn in ("min", "max") and "distinct" in spec:
        raise GraphError(f"{fn} has no distinct form")
    if fn != "count" and not key:
        raise GraphError(f"{fn} needs a property")
    return _BY_NAME[fn](key) if fn in ("min", "max") else _BY_NAME[fn](key, distinct)
