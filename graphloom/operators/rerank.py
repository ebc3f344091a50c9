"""Reranking: a scorer given by the user orders a bounded number of candidates. It runs on the driver, over those only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions import projection
from graphloom.operators import similarity


#: Documents that one question may make.
MAX_DOCUMENTS = 5000


@dataclass(frozen=True)
class Rerank:
    """``scorer(query, documents)`` gives a number for each document.

    ``document_from`` makes a candidate's document: a function of its row, or a filter (``functions.projection``) of
    {"id", "properties", "similarity", "paths"}. ``paths`` are the routes that lead to it, each a list of the nodes before it; only
    hops have them. With ``per_path`` each route makes a document, and the best of them counts.
    """

    scorer: Callable[[str, list[str]], Sequence[float]]
    query: str
    document_from: Callable[[dict], str] | str
    candidates: int = 50
    batch_size: int = 100
    per_path: bool = False
    max_paths: int = 10
    fields: Sequence[str] | None = None

    def __post_init__(self):
        if isinstance(self.document_from, str):
            object.__setattr__(self, "filter", projection.compile_filter(self.document_from, self.fields))
        elif self.fields is not None:
            raise GraphError("fields are for a document_from that is a filter")
        else:
            object.__setattr__(self, "filter", None)
        if not callable(self.scorer) or self.filter is None and not callable(self.document_from):
            raise GraphError("scorer and document_from are functions")
        if min(self.candidates, self.batch_size, self.max_paths) < 1:
            raise GraphError("candidates, batch_size and max_paths are positive")
        if self.per_path and self.filter is None:
            raise GraphError("per_path needs a document_from that is a filter")

    @property
    def wants_paths(self) -> bool:
        return self.filter is not None and (self.per_path or self.filter.reads("paths"))

    def document(self, row: dict) -> str:
        return self.document_from(row) if self.filter is None else self.filter.document(candidate(row))

    def scores(self, rows: list[dict]) -> list[float]:
        """A score for each row, the best one of its documents'."""
        own = [[{**r, "paths": [p]} for p in r["paths"]] if self.per_path and r.get("paths") else [r] for r in rows]
        if sum(map(len, own)) > MAX_DOCUMENTS:
            raise GraphError(f"more than {MAX_DOCUMENTS} documents")
        documents = [self.document(r) for rs in own for r in rs]
        if not all(isinstance(d, str) and d for d in documents):
            raise GraphError("document_from must give a text for every candidate")
        got = iter(self._scored(documents))
        return [max(next(got) for _ in rs) for rs in own]

    def _scored(self, documents: list[str]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(documents), self.batch_size):
            part = documents[i : i + self.batch_size]
            got = _paired(list(self.scorer(self.query, part)), len(part))
            if len(got) != len(part):
                raise GraphError(f"the scorer gave {len(got)} scores for {len(part)} documents")
            if any(isinstance(s, bool | str) or not math.isfinite(s) for s in got):
                raise GraphError("scores are finite numbers")
            out += map(float, got)
        return out


def _paired(got: list, several: int) -> list:
    """Scores in the order of the documents: as they come, or by the ``index`` of results that have one (and a ``score``)."""

    def of(x, name: str):
        return x.get(name) if isinstance(x, dict) else getattr(x, name, None)

    if not got or isinstance(got[0], int | float | str) or of(got[0], "index") is None:
        return got
    by = {of(x, "index"): of(x, "score") if of(x, "score") is not None else of(x, "relevance_score") for x in got}
    if sorted(by) != list(range(several)) or len(got) != several:
        raise GraphError("the scorer's results must have every index once")
    return [by[i] for i in range(several)]


def candidate(row: dict) -> dict:
    """What a filter sees of a row."""
    reserved = {"id", "graph_id", "start_id", "end_id", "similarity", "similarities", "boosts", "paths", "properties"}
    properties = row["properties"] if "properties" in row else {k: v for k, v in row.items() if k not in reserved and v is not None}
    out = {"id": str(row["id"]), "properties": properties}
    return out | {k: row[k] for k in ("similarity", "paths") if k in row} | {k: str(row[k]) for k in ("start_id", "end_id") if k in row}


@dataclass(frozen=True)
class RerankPolicy:
    """What a question that comes as JSON may change of a rerank: the filter, within ``fields``, and how many candidates."""

    template: Rerank
    fields: Sequence[str]
    max_candidates: int = 200

    def __post_init__(self):
        if not self.fields or isinstance(self.fields, str):
            raise GraphError("a policy lists the fields that filters may read")
        if self.max_candidates < 1:
            raise GraphError("max_candidates is positive")

    def parse(self, spec: object) -> Rerank:
        """{"document_from", "candidates"}, both optional; errors don't repeat what was sent."""
        if not isinstance(spec, dict) or set(spec) - {"document_from", "candidates"}:
            raise GraphError("a rerank has document_from and candidates only")
        several = spec.get("candidates", min(self.template.candidates, self.max_candidates))
        if isinstance(several, bool) or not isinstance(several, int) or not 1 <= several <= self.max_candidates:
            raise GraphError(f"candidates is a number from 1 to {self.max_candidates}")
        if "document_from" not in spec:
            return replace(self.template, candidates=several)
        if not isinstance(spec["document_from"], str):
            raise GraphError("document_from is a filter")
        return replace(self.template, document_from=spec["document_from"], candidates=several, fields=tuple(self.fields))


def _plain(row) -> dict:
    return {k: v.toPython() if hasattr(v, "toPython") else v for k, v in row.asDict().items() if not k.startswith(("vec_", "__"))}


def flat(hits: DataFrame, near, boost, rerank: Rerank, k: int | None) -> DataFrame:
    """The hits of a vector search with ``rerank_score``, the best k by it, ties by id as text."""
    own = [c for c in hits.columns if not c.startswith(("vec_", "__")) and c != "similarity"]
    hits = hits.select(*own, *similarity.report(hits, near, boost))
    rows = hits.collect()
    scores = rerank.scores([_plain(r) for r in rows])
    order = sorted(zip(rows, scores), key=lambda x: (-x[1], str(x[0]["id"])))[:k]
    table = hits.sparkSession.createDataFrame([(r["id"], s) for r, s in order], "id long, rerank_score double")
    return hits.join(F.broadcast(table), "id").orderBy(F.desc("rerank_score"), F.col("id").cast("string"))


def _paths(graph, walks: DataFrame, ids: Sequence[int], most: int) -> dict[int, list[list[dict]]]:
    """Up to ``most`` routes to each node, the shortest first and then by their ids: the nodes before it, as a filter sees them."""
    order = W.partitionBy("to_id").orderBy(F.size("path"), "path")
    few = walks.where(F.col("to_id").isin(list(ids))).select("to_id", "path").distinct().withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most)
    routes = few.orderBy("to_id", "__rank").collect()
    nodes = {x for r in routes for x in r["path"][:-1]}
    known = {r["id"]: candidate(_plain(r)) for r in graph.nodes.where(F.col("id").isin(list(nodes))).collect()} if nodes else {}
    out: dict[int, list[list[dict]]] = {}
    for r in routes:
        out.setdefault(r["to_id"], []).append([known.get(x, {"id": str(x), "properties": {}}) for x in r["path"][:-1]])
    return out


def step(graph, rows: DataFrame, spec, walks: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The ids that a start or hop keeps: its candidates by similarity, if it has any, then by score.

    ``walks`` gives the walks (to_id, path) that end in some nodes.
    """
    r: Rerank = spec.rerank
    if r.wants_paths and walks is None:
        raise GraphError("a start has no paths")
    if spec.keep is None or r.candidates <= spec.keep:
        raise GraphError("reranking a step needs keep, and more candidates than that")
    if spec.near:
        rows = similarity.best(similarity.scored(rows, graph._with_vectors(spec.near), graph.node_access, spec.boost), r.candidates)
    else:
        rows = rows.orderBy("id").limit(r.candidates)
    found = rows.collect()
    plain = [_plain(x) for x in found]
    if r.wants_paths and found:
        ids = [x["id"] for x in found]
        routes = _paths(graph, walks(graph.spark.createDataFrame([(i,) for i in ids], "id long")), ids, r.max_paths)
        plain = [{**x, "paths": routes.get(x["id"], [])} for x in plain]
    scores = r.scores(plain)
    kept = sorted(zip(found, scores), key=lambda x: (-x[1], str(x[0]["id"])))[: spec.keep]
    return graph.spark.createDataFrame([(x["id"],) for x, _ in kept], "id long")
