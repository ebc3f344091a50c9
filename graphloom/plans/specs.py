"""What a query is made of: a start, hops, vector conditions, boosts. Plain values that check themselves."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from graphloom.errors import GraphError


def _flag(value: object, name: str) -> None:
    if not isinstance(value, bool):
        raise GraphError(f"{name} must be True or False, not {value!r}")


@dataclass(frozen=True)
class Near:
    """Closeness of one vector field to a query vector, by cosine; or to what the field's embedder makes of a text."""

    field: str
    query: Sequence[float] | None = None
    weight: float = 1.0
    min_similarity: float | None = None
    missing: str = "exclude"
    text: str | None = None

    def of(self, query: Sequence[float]) -> Near:
        return replace(self, query=query, text=None)

    def __post_init__(self):
        if (self.query is None) == (self.text is None):
            raise GraphError("give a query vector or a text")
        if self.text is not None and (not isinstance(self.text, str) or not self.text.strip()):
            raise GraphError("text must be a text that isn't blank")
        if self.text is not None and re.fullmatch(r"\s*\[[\d\s,.eE+-]*\]\s*", self.text):
            raise GraphError("this text looks like a vector: give it as query, a list of numbers")
        if self.query is not None and (isinstance(self.query, str) or not len(self.query)):
            raise GraphError("query must be a vector of numbers")
        values = [float(x) for x in (() if self.query is None else self.query)]
        if not all(map(math.isfinite, values)):
            raise GraphError("a query vector can't hold NaN or infinity")
        if self.query is not None and not any(values):
            raise GraphError("a query vector of zeros has no direction")
        if not self.weight or not math.isfinite(self.weight):
            raise GraphError("weight must be a finite number other than 0")
        if self.min_similarity is not None and not -1 <= self.min_similarity <= 1:
            raise GraphError("min_similarity lies between -1 and 1")
        if self.missing not in ("exclude", "zero"):
            raise GraphError("missing is 'exclude' or 'zero'")
        object.__setattr__(self, "query", tuple(values) if self.query is not None else None)


@dataclass(frozen=True)
class Boost:
    """A number of the row added to its score, as it is or stretched to 0..1 over all candidates."""

    key: str | Callable
    weight: float = 1.0
    default: float = 0.0
    scale: str = "normalized"

    def __post_init__(self):
        if self.scale not in ("normalized", "raw"):
            raise GraphError("scale is 'normalized' or 'raw'")
        if not all(map(math.isfinite, (self.weight, self.default))):
            raise GraphError("weight and default must be finite")

    @property
    def name(self) -> str:
        return self.key if isinstance(self.key, str) else getattr(self.key, "__name__", "boost")


def _nears(near: object) -> tuple[Near, ...]:
    out = () if near is None else (near,) if isinstance(near, Near) else tuple(near)
    if not all(isinstance(n, Near) for n in out):
        raise GraphError("near takes Near conditions")
    names = [n.field for n in out]
    if len(set(names)) < len(names):
        raise GraphError("a vector field can appear only once")
    if len(out) == 1 and out[0].missing == "zero":
        raise GraphError("missing='zero' needs more than one field")
    return out


def _boosts(boost: object) -> tuple[Boost, ...]:
    return () if boost is None else (boost,) if isinstance(boost, Boost) else tuple(boost)


@dataclass(frozen=True)
class Start:
    """The nodes a traversal starts from: filtered, by id, or the nearest."""

    where: object = None
    ids: Sequence[int] | None = None
    label: str | None = None
    near: object = ()
    keep: int | None = None
    boost: object = ()
    rerank: object = None

    def __post_init__(self):
        object.__setattr__(self, "near", _nears(self.near))
        object.__setattr__(self, "boost", _boosts(self.boost))
        if self.ids is not None:
            try:
                object.__setattr__(self, "ids", tuple(int(i) for i in self.ids))
            except (TypeError, ValueError) as e:
                raise GraphError("ids must be integers") from e
        _beam(self.near, self.keep, self.boost, self.rerank, "near", "keep")


def _beam(near, keep, boost, rerank, near_name: str, keep_name: str) -> None:
    if keep is not None and (isinstance(keep, bool) or not isinstance(keep, int) or keep < 1):
        raise GraphError(f"{keep_name} must be a positive integer")
    if keep is not None and not near and rerank is None:
        raise GraphError(f"{keep_name} needs {near_name}")
    if near and keep is None and all(n.min_similarity is None for n in near):
        raise GraphError(f"{near_name} needs {keep_name} or a min_similarity")
    if boost and not near:
        raise GraphError(f"boost needs {near_name}")
    if rerank is not None and keep is None:
        raise GraphError(f"rerank needs {keep_name}")


@dataclass(frozen=True)
class Hop:
    """One step of a traversal: over one edge, or a range of them, to nodes that match."""

    where: object = None
    via: object = None
    hops: int | tuple[int, int] = 1
    direction: str = "forward"
    optional: bool = False
    label: str | None = None
    near: object = ()
    keep: int | None = None
    via_near: object = ()
    via_keep: int | None = None
    boost: object = ()
    rerank: object = None
    low: int = field(init=False, default=1)
    high: int = field(init=False, default=1)

    def __post_init__(self):
        pair = (self.hops, self.hops) if isinstance(self.hops, int) and not isinstance(self.hops, bool) else tuple(self.hops) if isinstance(self.hops, list | tuple) else ()
        if len(pair) != 2 or not all(isinstance(x, int) and not isinstance(x, bool) for x in pair) or pair[0] < 1 or pair[1] < pair[0]:
            raise GraphError(f"hops is a number from 1 or (min, max), not {self.hops!r}")
        if self.direction not in ("forward", "backward"):
            raise GraphError("direction is 'forward' or 'backward'")
        _flag(self.optional, "optional")
        for name, value in (("low", pair[0]), ("high", pair[1]), ("near", _nears(self.near)), ("via_near", _nears(self.via_near)), ("boost", _boosts(self.boost))):
            object.__setattr__(self, name, value)
        _beam(self.near, self.keep, self.boost, self.rerank, "near", "keep")
        _beam(self.via_near, self.via_keep, (), None, "via_near", "via_keep")


def check_chain(hops: Sequence[Hop]) -> None:
    if any(h.optional for h in hops[:-1]):
        raise GraphError("only the last hop can be optional")
