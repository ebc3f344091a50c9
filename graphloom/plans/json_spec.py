"""The JSON forms of traversals, aggregations and vector searches; unknown keys are refused."""

from __future__ import annotations

from graphloom.errors import GraphError
from graphloom.functions.filters import parse_filter
from graphloom.operators.aggregates import parse_aggregate
from graphloom.plans.specs import Boost, Hop, Near, Start


def _known(spec: object, keys: set[str], what: str) -> dict:
    if not isinstance(spec, dict):
        raise GraphError(f"{what} is a JSON object, not {spec!r}")
    if extra := set(spec) - keys:
        raise GraphError(f"{what} has no {sorted(extra)}; it has {sorted(keys)}")
    return spec


def near(spec: object, allow_vectors: bool = True, embed=None) -> tuple[Near, ...]:
    """Conditions of vectors or texts; a text's vector is made by ``embed``, or later by the embedder of its field."""
    out = []
    for s in spec if isinstance(spec, list) else [spec]:
        s = _known(s, {"field", "vector", "text", "weight", "min_similarity", "missing"}, "near")
        if "vector" in s and not allow_vectors:
            raise GraphError("give text; vectors aren't taken here")
        if ("vector" in s) == ("text" in s):
            raise GraphError("near has either a vector or a text")
        rest = {k: s[k] for k in ("weight", "min_similarity", "missing") if k in s}
        if "text" in s and embed is None:
            out.append(Near(s["field"], text=s["text"], **rest))
        else:
            out.append(Near(s["field"], s["vector"] if "vector" in s else embed(s["text"]), **rest))
    return tuple(out)


def boost(spec: object) -> tuple[Boost, ...]:
    rows = spec if isinstance(spec, list) else [spec]
    return tuple(Boost(**_known(s, {"key", "weight", "default", "scale"}, "boost")) for s in rows)


def _step(spec: dict, kind, keys: set[str], rerank=None, allow_vectors: bool = True):
    args = dict(_known(spec, keys, kind.__name__.lower()))
    for k in ("where", "via"):
        if k in args and not (k == "via" and isinstance(args[k], str)):
            args[k] = parse_filter(args[k])
    for k in ("near", "via_near"):
        if k in args:
            args[k] = near(args[k], allow_vectors)
    if "boost" in args:
        args["boost"] = boost(args["boost"])
    if "rerank" in args:
        if rerank is None:
            raise GraphError("reranking isn't allowed here")
        args["rerank"] = rerank.parse(args["rerank"])
    if isinstance(args.get("hops"), list):
        args["hops"] = tuple(args["hops"])
    return kind(**args)


def traversal(spec: dict, rerank=None, allow_vectors: bool = True) -> tuple[Start | Hop, ...]:
    """{"start": {...}, "hops": [{...}, ...]}"""
    spec = _known(spec, {"start", "hops"}, "a traversal")
    if "start" not in spec:
        raise GraphError("a traversal needs a start")
    start = _step(spec["start"], Start, {"where", "ids", "label", "near", "keep", "boost", "rerank"}, rerank, allow_vectors)
    hops = [_step(h, Hop, {"where", "via", "hops", "direction", "optional", "label", "near", "keep", "via_near", "via_keep", "boost", "rerank"}, rerank, allow_vectors) for h in spec.get("hops", [])]
    return (start, *hops)


def aggregation(spec: dict, rerank=None, allow_vectors: bool = True):
    """A traversal with {"aggregates": {name: {"fn", "property", "distinct"}}, "group_by": key}."""
    spec = _known(spec, {"start", "hops", "aggregates", "group_by"}, "an aggregation")
    start, *hops = traversal({k: spec[k] for k in ("start", "hops") if k in spec}, rerank, allow_vectors)
    if not isinstance(spec.get("aggregates"), dict):
        raise GraphError("aggregates is an object of names")
    return start, hops, {n: parse_aggregate(a) for n, a in spec["aggregates"].items()}, spec.get("group_by")


def vector_search(graph, spec: dict, rerank=None, allow_vectors: bool = True):
    """{"near": ..., "target", "k", "where", "boost", "rerank"}"""
    spec = _known(spec, {"near", "target", "k", "where", "boost", "rerank"}, "a vector search")
    rest = {k: spec[k] for k in ("target", "k") if k in spec}
    if "rerank" in spec:
        if rerank is None:
            raise GraphError("reranking isn't allowed here")
        rest["rerank"] = rerank.parse(spec["rerank"])
    return graph.vector_search(*near(spec["near"], allow_vectors), where=parse_filter(spec.get("where")), boost=boost(spec["boost"]) if "boost" in spec else (), **rest)
