"""Filters: Python objects and their JSON form, compiled to one Column for either way of storing properties.

Equality is containment and two-valued: a missing key makes it false, so NOT holds for it. Comparisons read a property's
text as a number and are null for a missing or other one; NOT leaves null as it is, and such rows drop out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.props import BagAccess, TypedAccess, false

Access = BagAccess | TypedAccess


class Filter:
    """Base of the operators."""


class _Many(Filter):
    def __init__(self, *filters):
        if not filters:
            raise GraphError(f"{type(self).__name__} needs at least one filter")
        self.filters = filters

    def __eq__(self, other):
        return type(self) is type(other) and self.filters == other.filters

    def __repr__(self):
        return f"{type(self).__name__}{self.filters!r}"

    __hash__ = None


class AND(_Many):
    """All hold."""


class OR(_Many):
    """One holds."""


@dataclass(eq=True)
class NOT(Filter):
    filter: object


@dataclass(eq=True)
class _Compare(Filter):
    key: str
    value: float

    def __post_init__(self):
        if isinstance(self.value, bool) or not isinstance(self.value, int | float):
            raise GraphError(f"{type(self).__name__} compares with a number, not {self.value!r}")


class GT(_Compare):
    """Above."""


class GTE(_Compare):
    """At least."""


class LT(_Compare):
    """Below."""


class LTE(_Compare):
    """At most."""


@dataclass(eq=True)
class BETWEEN(Filter):
    """From low to high, both included."""

    key: str
    low: float
    high: float


@dataclass(eq=True)
class HasKey(Filter):
    """The key is there, be it with an explicit null."""

    key: str
    present: bool = True


_COMPARE: dict[type, Callable[[Column, object], Column]] = {GT: lambda a, b: a > b, GTE: lambda a, b: a >= b, LT: lambda a, b: a < b, LTE: lambda a, b: a <= b}


def compile_filter(f: object, access: Access, top: bool = True) -> Column:
    """The Column of a filter. ``top``: a null result may stand for false, so comparisons may go to the scan unguarded."""
    if f is None or f == {}:
        return F.lit(True)
    if isinstance(f, AND):
        return reduce(lambda a, b: a & b, (compile_filter(x, access, top) for x in f.filters))
    if isinstance(f, OR):
        return reduce(lambda a, b: a | b, (compile_filter(x, access, top) for x in f.filters))
    if isinstance(f, NOT):
        return ~compile_filter(f.filter, access, False)
    if type(f) in _COMPARE:
        return _COMPARE[type(f)](access.numeric_text(f.key), F.lit(float(f.value)))
    if isinstance(f, BETWEEN):
        return access.numeric_text(f.key).between(float(f.low), float(f.high))
    if isinstance(f, HasKey):
        return access.has(f.key) if f.present else ~access.has(f.key)
    if isinstance(f, dict):
        return reduce(lambda a, b: a & b, (_key(k, v, access, top) for k, v in f.items()))
    if isinstance(f, list | tuple):
        raise GraphError("a bare list isn't a filter: write AND(...) or OR(...)")
    if callable(f) and not isinstance(f, type):
        return f(access)
    raise GraphError(f"not a filter: {f!r}")


def _key(key: str, value: object, access: Access, top: bool) -> Column:
    if isinstance(value, list | tuple | set):
        values = list(value)
        if not values:
            return false()
        if top and all(access.pushable(key, v) is not None for v in values):
            return access.raw(key).isin(values)
        return reduce(lambda a, b: a | b, (access.equals(key, v) for v in values))
    if hasattr(value, "query") or isinstance(value, Filter):
        raise GraphError(f"the value of {key!r} must be plain JSON: similarity goes into near=, operators stand for themselves")
    bare = access.pushable(key, value) if top else None
    return access.equals(key, value) if bare is None else bare


def compile_via(via: object, access: Access) -> Column:
    """As ``compile_filter``; a string is the kind of the edge."""
    if isinstance(via, str):
        if not via:
            raise GraphError("via can't be an empty string")
        return access.text("kind") == F.lit(via)
    return compile_filter(via, access)


def parse_filter(spec: object) -> object:
    """A filter from its JSON form: {"and": [...]}, {"or": [...]}, {"not": f}, {"gt": [key, number]}, {"between": [key, low, high]} or properties."""
    if spec is None:
        return None
    if not isinstance(spec, dict):
        raise GraphError(f"a filter is a JSON object, not {spec!r}")
    words = {"and", "or", "not", "gt", "gte", "lt", "lte", "between"}
    used = words & set(spec)
    if not used:
        return spec
    if len(spec) > 1:
        raise GraphError(f"{sorted(used)[0]!r} stands alone in its object; combine with and")
    word, value = next(iter(spec.items()))
    if word in ("and", "or"):
        if not isinstance(value, list) or not value:
            raise GraphError(f"{word!r} takes a list of filters")
        return (AND if word == "and" else OR)(*map(parse_filter, value))
    if word == "not":
        return NOT(parse_filter(value))
    size = 3 if word == "between" else 2
    if not isinstance(value, list) or len(value) != size or not isinstance(value[0], str):
        raise GraphError(f"{word!r} takes [key, {'low, high' if size == 3 else 'number'}]")
    return {"gt": GT, "gte": GTE, "lt": LT, "lte": LTE, "between": BETWEEN}[word](*value)
